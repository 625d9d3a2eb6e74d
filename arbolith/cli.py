"""Commands on dumps and saved stores: python -m arbolith.cli COMMAND ...

buildott FOLDER TARGET          a store of a folder of dumps (makes contexts, genus and path tables as well)
loadtaxsyn SOURCE TAXONOMY SYNONYMS FORWARDS TARGET   the same of single files
adddeprecated STORE FILE TARGET the store with the retired ids of a file
makecontexts STORE              number of taxa of each context
makegenusindexes STORE          number of species of each genus
getsubtree STORE ID...          the tree that the taxa span, as Newick
recalculatemrcas STORE TARGET   the tips and inner taxa below each taxon, made anew, a row each
writenewick STORE ID TARGET     a taxon's preferred subtree as Newick in text files
tnrsbasic STORE NAME,NAME,...   the matches of names, in words
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith import runtime, schema
from arbolith.functions import taxon
from arbolith.operators import exports, resolve
from arbolith.operators import tree as trees
from arbolith.sources import dumps
from arbolith.store import Store, open_store


def buildott(spark: SparkSession, folder: str, target: str) -> None:
    dumps.load_dumps(spark, folder).save(target)


def loadtaxsyn(spark: SparkSession, source: str, taxonomy: str, synonyms: str, forwards: str, target: str) -> None:
    metadata = spark.createDataFrame([(source, None, None)], schema.METADATA)
    retired = spark.createDataFrame([], schema.DEPRECATED_RAW)
    Store(dumps.read_taxonomy(spark, taxonomy), dumps.read_synonyms(spark, synonyms), dumps.read_forwards(spark, forwards), retired, metadata).save(target)


def adddeprecated(spark: SparkSession, path: str, file: str, target: str) -> None:
    store = open_store(spark, path)
    more = dumps.read_deprecated(spark, file).withColumn("name_lc", F.lower("name"))
    store.deprecated = store.deprecated.unionByName(more).distinct()
    store.save(target)


def makecontexts(spark: SparkSession, path: str) -> DataFrame:
    return open_store(spark, path).context_members.groupBy("context").agg(F.count("*").alias("n_taxa")).orderBy("context")


def makegenusindexes(spark: SparkSession, path: str) -> DataFrame:
    store = open_store(spark, path)
    return trees.genus_members(store.pref_tree, store.taxa).groupBy("genus_ott_id").agg(F.count("*").alias("n_species")).orderBy("genus_ott_id")


def getsubtree(spark: SparkSession, path: str, *ids: str) -> DataFrame:
    store = open_store(spark, path)
    return trees.induced_newick(store, spark.createDataFrame([(int(i),) for i in ids], "ott_id long")).select("newick")


def recalculatemrcas(spark: SparkSession, path: str, target: str) -> None:
    trees.below_members(open_store(spark, path).tree).write.mode("overwrite").parquet(target)


def writenewick(spark: SparkSession, path: str, top: str, target: str) -> None:
    exports.write_newick(open_store(spark, path), int(top), target)


def tnrsbasic(spark: SparkSession, path: str, names: str) -> DataFrame:
    store = open_store(spark, path)
    listed = spark.createDataFrame([(names,)], "q string").select(F.posexplode(taxon.comma_list(F.trim("q"))).alias("query_id", "qname")).where("qname <> ''")
    matches = resolve.match_names(store, listed, approximate=True)
    return exports.result_lines(listed, resolve.describe(matches, store.taxa)).orderBy("query_id").select("qname", "lines")


COMMANDS = {f.__name__: f for f in (buildott, loadtaxsyn, adddeprecated, makecontexts, makegenusindexes, getsubtree, recalculatemrcas, writenewick, tnrsbasic)}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    out = COMMANDS[args[0]](spark or runtime.session("arbolith"), *args[1:])
    if out is not None:
        for row in out.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
