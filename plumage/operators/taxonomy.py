"""Species names and classes: dictionary builds, cascaded look-ups, backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = ["order_cn", "family_cn", "genus_cn", "species_cn"]
#: Names of unknown ranks.
UNKNOWN = {"order_cn": "未知目", "family_cn": "未知科", "genus_cn": "未知属", "species_cn": "未知种"}


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """SRC21: for each non-blank key, the row with the highest ordinal."""
    return _one(rows, key, F.max_by(F.struct(*rows.columns), F.col(ordinal)))


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """SRC21, SRC22: for each non-blank key, the row with the lowest ordinal."""
    return _one(rows, key, F.min_by(F.struct(*rows.columns), F.col(ordinal)))


def _one(rows: DataFrame, key: str, pick) -> DataFrame:
    named = rows.filter(F.trim(key) != "")
    return named.groupBy(F.trim(F.col(key)).alias("_key")).agg(pick.alias("_row")).select(F.col("_key"), *[F.col("_row").getField(c).alias(c) for c in rows.columns])


def classified(names: DataFrame, taxonomy: DataFrame, genera: DataFrame) -> DataFrame:
    """JN1: classes of ``names(cn, sci)`` by scientific name, genus, Chinese name, genus table.

    ``taxonomy(ord, species_cn, order_cn, family_cn, genus_cn, name_la, genus_la)``;
    ``genera(genus, order_cn, family_cn)``. Adds the four ranks and ``matched``. A
    genus match keeps the given Chinese name. All four are left joins by equality
    on unique keys: no row is lost or doubled.
    """
    ranks = lambda name, key: last_wins(taxonomy, key, "ord").select(F.col("_key").alias(f"_k_{name}"), F.struct(*RANKS).alias(f"_{name}"))
    by_genus = first_wins(taxonomy, "genus_la", "ord").select(F.col("_key").alias("_k_genus"), F.struct(*RANKS).alias("_genus"))
    table = genera.select(F.col("genus").alias("_k_table"), F.struct("order_cn", "family_cn", F.col("genus").alias("genus_cn")).alias("_table"))
    genus = F.get(F.split(F.trim("sci"), r"\s+"), F.lit(0))
    df = names.join(ranks("sci", "name_la"), F.col("sci") == F.col("_k_sci"), "left").join(by_genus, genus == F.col("_k_genus"), "left")
    df = df.join(ranks("cn", "species_cn"), F.col("cn") == F.col("_k_cn"), "left").join(table, genus == F.col("_k_table"), "left")
    given = F.nullif(F.col("cn"), F.lit(""))
    matched = F.when(F.col("_k_sci").isNotNull(), "sci").when(F.col("_k_genus").isNotNull(), "genus").when(F.col("_k_cn").isNotNull(), "cn").when(F.col("_k_table").isNotNull(), "table").otherwise("none")
    out = {}
    for r in RANKS:
        fallback = F.coalesce(given, F.lit(UNKNOWN[r])) if r == "species_cn" else F.coalesce(F.col("_table").getField(r), F.nullif(genus, F.lit("")) if r == "genus_cn" else F.lit(None), F.lit(UNKNOWN[r]))
        by = F.coalesce(given, F.col("_genus").getField(r)) if r == "species_cn" else F.col("_genus").getField(r)
        out[r] = F.when(matched == "sci", F.col("_sci").getField(r)).when(matched == "genus", by).when(matched == "cn", F.col("_cn").getField(r)).otherwise(fallback)
    return df.withColumns({**out, "matched": matched}).select(*names.columns, *RANKS, "matched")


def normalised_names(candidates: DataFrame, taxonomy: DataFrame, species: DataFrame) -> DataFrame:
    """JN2: canonical Chinese names by scientific name, and missing species indexes.

    ``candidates(idx, cn, sci, ...)``; ``species(idx, cn, sci)``. The name as given
    stays in ``cn_raw`` where it changes; the index by Chinese name uses that one.
    """
    canon = last_wins(taxonomy, "name_la", "ord").select(F.col("_key").alias("_s"), F.nullif(F.trim("species_cn"), F.lit("")).alias("_std"))
    by_sci = species.filter(F.trim("sci") != "").groupBy(F.trim("sci").alias("_s2")).agg(F.min("idx").alias("_i1"))
    by_cn = species.filter(F.trim("cn") != "").groupBy(F.trim("cn").alias("_c2")).agg(F.min("idx").alias("_i2"))
    sci, cn = F.trim(F.coalesce("sci", F.lit(""))), F.trim(F.coalesce("cn", F.lit("")))
    df = candidates.join(canon, sci == F.col("_s"), "left").join(by_sci, sci == F.col("_s2"), "left").join(by_cn, cn == F.col("_c2"), "left")
    known = F.nullif(F.col("idx"), F.lit(-1))
    return df.withColumns({"_idx": F.coalesce(known, "_i1", "_i2"), "cn_raw": F.when((cn != "") & (F.col("_std") != cn), cn), "_cn": F.coalesce("_std", "cn")}).withColumns({"idx": F.col("_idx"), "cn": F.col("_cn")}).drop("_s", "_std", "_s2", "_i1", "_c2", "_i2", "_idx", "_cn")


def whitelist(region_species: DataFrame, code_index: DataFrame) -> DataFrame:
    """JN4, SRC24: distinct ``(region, idx)`` of regions below a country; unknown codes go.

    ``region_species(ord, region_key, region_name, species_code)``, ``ord`` being the
    region's place in the file; regions need a key beyond ``CN-`` and a name that isn't
    a key. Of regions of one name that have a known code the last in the file counts.
    """
    if "ord" not in region_species.columns:
        raise ValueError("regions need their place in the file, in a column 'ord'")
    at = F.col("ord")
    named = region_species.filter(F.col("region_key").startswith("CN-") & (F.length("region_key") > 4) & (F.trim("region_name") != "") & ~F.trim("region_name").startswith("CN-"))
    rows = named.join(code_index, F.col("species_code") == F.col("code")).select(F.trim("region_name").alias("region"), "region_key", at.alias("_at"), "idx")
    owner = rows.groupBy("region").agg(F.max_by("region_key", F.struct("_at", "region_key")).alias("region_key"))
    return rows.join(owner, ["region", "region_key"]).select("region", "idx").distinct()


def national_list(region_species: DataFrame, code_index: DataFrame, country: str = "CN") -> DataFrame:
    """SRC23, SET3: distinct ``idx`` of the country and all its regions."""
    rows = region_species.filter(F.col("region_key").rlike(f"^{country}($|-)"))
    return rows.join(code_index, F.col("species_code") == F.col("code")).select("idx").distinct()
