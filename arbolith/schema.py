"""Fixed tables of the data model: flags, contexts, barrier clades, ranks, label formats, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Flags that hide a taxon, and flags that don't. The constant of a flag is its label
# in upper case but for one.
SUPPRESSING = ("not_otu", "environmental", "environmental_inherited", "viral", "hidden", "hidden_inherited", "unclassified_direct", "was_container")
OTHER_FLAGS = (
    "barren", "extinct", "extinct_direct", "extinct_inherited", "major_rank_conflict", "major_rank_conflict_direct",
    "major_rank_conflict_inherited", "unclassified", "unclassified_inherited", "edited", "hybrid", "incertae_sedis",
    "incertae_sedis_inherited", "incertae_sedis_direct", "infraspecific", "sibling_lower", "sibling_higher", "tattered",
    "tattered_inherited", "forced_visible", "unplaced", "unplaced_inherited", "inconsistent", "merged",
)
FLAGS = SUPPRESSING + OTHER_FLAGS
FLAG_CONSTANTS = {f: f.upper() for f in FLAGS} | {"forced_visible": "FORCE_VISIBLE"}
OVERRIDE = "forced_visible"

# Ranks at or below species, and the shorter list by which autocompletion tells higher taxa.
SPECIFIC_RANKS = ("species", "subspecies", "variety", "varietas", "forma", "form")
NOT_HIGHER_RANKS = ("species", "subspecies", "variety", "forma")

LABEL_FORMATS = ("name", "id", "name_and_id", "original_name")

ROOT_ID, ROOT_NAME, ALL_LIFE = 805080, "life", "All life"

# Context name, group, index suffix, name and id of its root taxon, nomenclatural code.
CONTEXTS = (
    ("ALLTAXA", "All life", "LIFE", "", "life", 805080, "undefined"),
    ("BACTERIA", "Bacteria", "MICROBES", "Bacteria", "Bacteria", 844192, "ICNP"),
    ("SAR", "SAR group", "MICROBES", "SAR", "SAR", 5246039, "undefined"),
    ("ARCHAEA", "Archaea", "MICROBES", "Archaea", "Archaea", 996421, "ICNP"),
    ("EXCAVATA", "Excavata", "MICROBES", "Excavata", "Excavata", 2927065, "undefined"),
    ("AMOEBAE", "Amoebozoa", "MICROBES", "Amoebae", "Amoebozoa", 1064655, "ICZN"),
    ("CENTROHELIDA", "Centrohelida", "MICROBES", "Centrohelida", "Centrohelida", 755852, "ICZN"),
    ("HAPTOPHYTA", "Haptophyta", "MICROBES", "Haptophyta", "Haptophyta", 151014, "undefined"),
    ("APUSOZOA", "Apusozoa", "MICROBES", "Apusozoa", "Apusozoa", 671092, "ICZN"),
    ("DIATOMS", "Diatoms", "MICROBES", "Diatoms", "Bacillariophyta", 5342311, "ICN"),
    ("CILIATES", "Ciliates", "MICROBES", "Ciliates", "Ciliophora", 302424, "undefined"),
    ("FORAMS", "Forams", "MICROBES", "Forams", "Foraminifera", 936399, "ICZN"),
    ("METAZOA", "Animals", "ANIMALS", "Animals", "Metazoa", 691846, "ICZN"),
    ("BIRDS", "Birds", "ANIMALS", "Birds", "Aves", 81461, "ICZN"),
    ("TETRAPODS", "Tetrapods", "ANIMALS", "Tetrapods", "Tetrapoda", 229562, "ICZN"),
    ("MAMMALS", "Mammals", "ANIMALS", "Mammals", "Mammalia", 244265, "ICZN"),
    ("AMPHIBIANS", "Amphibians", "ANIMALS", "Amphibians", "Amphibia", 544595, "ICZN"),
    ("VERTEBRATES", "Vertebrates", "ANIMALS", "Vertebrates", "Vertebrata", 801601, "ICZN"),
    ("ARTHROPODS", "Arthropods", "ANIMALS", "Arthopods", "Arthropoda", 632179, "ICZN"),
    ("MOLLUSCS", "Molluscs", "ANIMALS", "Molluscs", "Mollusca", 802117, "ICZN"),
    ("NEMATODES", "Nematodes", "ANIMALS", "Nematodes", "Nematoda", 395057, "ICZN"),
    ("PLATYHELMINTHES", "Platyhelminthes", "ANIMALS", "Platyhelminthes", "Platyhelminthes", 555379, "ICZN"),
    ("ANNELIDS", "Annelids", "ANIMALS", "Annelids", "Annelida", 941620, "ICZN"),
    ("CNIDARIA", "Cnidarians", "ANIMALS", "Cnidarians", "Cnidaria", 641033, "ICZN"),
    ("ARACHNIDES", "Arachnids", "ANIMALS", "Arachnids", "Arachnida", 511967, "ICZN"),
    ("INSECTS", "Insects", "ANIMALS", "Insects", "Insecta", 1062253, "ICZN"),
    ("FUNGI", "Fungi", "FUNGI", "Fungi", "Fungi", 352914, "ICN"),
    ("BASIDIOMYCOTA", "Basidiomycetes", "FUNGI", "Basidiomycetes", "Basidiomycota", 634628, "ICN"),
    ("ASCOMYCOTA", "Ascomycetes", "FUNGI", "Ascomycota", "Ascomycota", 439373, "ICN"),
    ("LAND_PLANTS", "Land plants", "PLANTS", "Plants", "Embryophyta", 5342313, "ICN"),
    ("HORNWORTS", "Hornworts", "PLANTS", "Anthocerotophyta", "Anthocerotophyta", 738980, "ICN"),
    ("MOSSES", "Mosses", "PLANTS", "Bryophyta", "Bryophyta", 246594, "ICN"),
    ("LIVERWORTS", "Liverworts", "PLANTS", "Marchantiophyta", "Marchantiophyta", 56601, "ICN"),
    ("VASCULAR_PLANTS", "Vascular plants", "PLANTS", "Tracheophyta", "Tracheophyta", 10210, "ICN"),
    ("LYCOPHYTES", "Club mosses", "PLANTS", "Lycopodiophyta", "Lycopodiophyta", 144803, "ICN"),
    ("FERNS", "Ferns", "PLANTS", "Moniliformopses", "Moniliformopses", 166292, "ICN"),
    ("SEED_PLANTS", "Seed plants", "PLANTS", "Spermatophyta", "Spermatophyta", 10218, "ICN"),
    ("FLOWERING_PLANTS", "Flowering plants", "PLANTS", "Magnoliophyta", "Magnoliophyta", 99252, "ICN"),
    ("MONOCOTS", "Monocots", "PLANTS", "Monocots", "Liliopsida", 1058517, "ICN"),
    ("EUDICOTS", "Eudicots", "PLANTS", "Eudicots", "eudicotyledons", 431495, "ICN"),
    ("ROSIDS", "Rosids", "PLANTS", "Rosids", "rosids", 1008296, "ICN"),
    ("ASTERIDS", "Asterids", "PLANTS", "Asterids", "asterids", 1008294, "ICN"),
    ("ASTERALES", "Asterales", "PLANTS", "Asterales", "Asterales", 1042120, "ICN"),
    ("ASTERACEAE", "Asteraceae", "PLANTS", "Asteraceae", "Asteraceae", 46248, "ICN"),
    ("ASTER", "Aster", "PLANTS", "Aster", "Aster", 409712, "ICN"),
    ("SYMPHYOTRICHUM", "Symphyotrichum", "PLANTS", "Symphyotrichum", "Symphyotrichum", 1058735, "ICN"),
    ("CAMPANULACEAE", "Campanulaceae", "PLANTS", "Campanulaceae", "Campanulaceae", 1086303, "ICN"),
    ("LOBELIA", "Lobelia", "PLANTS", "Lobelia", "Lobelia", 1086294, "ICN"),
)
CONTEXT_SCHEMA = "enum_name string, name string, grp string, suffix string, root_name string, root_ott_id long, code string"

# Clades across which a name may be used again, their code, and other names they go by.
BARRIERS = (
    ("Fungi", "ICN"), ("Viridiplantae", "ICN"), ("Bacteria", "ICNP"), ("Metazoa", "ICZN"), ("Alveolata", "ICN"), ("Rhodophyta", "ICN"),
    ("Glaucocystophyceae", "ICN"), ("Haptophyceae", "ICN"), ("Choanoflagellida", "ICZN"),
)
BARRIER_ALTERNATIVES = (("Metazoa", "Animalia"), ("Viridiplantae", "Plantae"))

NO_CODE = "undetermined"

TAXA_RAW = "ott_id long, parent_ott_id long, name string, rank string, input_sources string, uniqname string, flags array<string>"
SYNONYMS_RAW = "ott_id long, name string, source string"
ALIASES_RAW = "alias_id long, ott_id long"
DEPRECATED_RAW = "ott_id long, name string, source_info string, reason string"
METADATA = "source string, author string, weburl string"


def contexts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTEXTS), CONTEXT_SCHEMA)


def flags(spark: SparkSession) -> DataFrame:
    rows = [(f, FLAG_CONSTANTS[f], f in SUPPRESSING) for f in FLAGS]
    return spark.createDataFrame(rows, "label string, constant string, suppresses boolean")
