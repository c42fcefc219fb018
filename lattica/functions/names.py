"""Scalar functions on names of features, samples and loci, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compose_id_name(id_: Column, name: Column) -> Column:
    """id_name, or the id alone where the name is empty, null or equal."""
    return F.when(name.isNull() | (name == "") | (name == id_), id_).otherwise(F.concat(id_, F.lit("_"), name))


def split_id_name(whole: Column) -> Column:
    """struct(id, name): split on the first underscore; both are the whole without one, or with nothing after it."""
    at = F.locate("_", whole)
    split = (at > 0) & (at < F.length(whole))
    return F.struct(F.when(split, F.substring(whole, F.lit(1), at - 1)).otherwise(whole).alias("id"), F.when(split, F.substring(whole, at + 1, F.length(whole))).otherwise(whole).alias("name"))


def flexible_match(query: Column, name: Column) -> Column:
    """Whether name is query, or has it as a whole part between underscores, letter case ignored."""
    q, n = F.lower(query), F.lower(name)
    return F.contains(F.concat(F.lit("_"), n, F.lit("_")), F.concat(F.lit("_"), q, F.lit("_")))


def contains_ignore_case(name: Column, part: Column) -> Column:
    return F.contains(F.lower(name), F.lower(part))


def chr_stripped(chromosome: Column) -> Column:
    """Drops a leading lower-case chr."""
    return F.regexp_replace(chromosome, "^chr", "")


def canon_locus(locus: Column) -> Column:
    """Drops chr, Chr or CHR and folds : and - to an underscore."""
    return F.regexp_replace(F.regexp_replace(locus, "^(chr|Chr|CHR)", ""), "[:-]", "_")


def parse_peak(name: Column) -> Column:
    """struct(chr, start, end) of chr:start-end or chr_start_end, else null."""
    pattern = r"^(.+)[:_]([0-9]+)[-_]([0-9]+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("chr"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def parse_ensembl_id(name: Column) -> Column:
    """The text before the first dot."""
    return F.substring_index(name, ".", 1)


def gene_key(name: Column) -> Column:
    """The text before the last /count/."""
    return F.regexp_replace(name, "/count/(?!.*/count/).*$", "")


def individual_of(name: Column) -> Column:
    """The text after the last @, or all."""
    return F.when(F.contains(name, F.lit("@")), F.substring_index(name, "@", -1)).otherwise(F.lit("all"))


def feature_row(unit: Column, modality: Column, channel: Column, subunit: Column | None = None) -> Column:
    """unit/modality[/subunit]/channel."""
    return F.concat_ws("/", unit, modality, *([subunit] if subunit is not None else []), channel)


#: Modalities and their channels.
MODALITIES = ("count", "m6a", "atoi", "apa", "baf")


def parse_feature_row(name: Column) -> Column:
    """struct(unit, modality, subunit, channel): the channel is peeled off the right, the modality found one or two fields before it; else three or four plain fields; else null. The unit may hold slashes."""
    f = F.split(name, "/")
    n = F.size(f)
    field = lambda back: F.when(n >= back, F.element_at(f, -back))
    unit = lambda back: F.array_join(F.slice(f, 1, F.greatest(n - back, F.lit(0))), "/")
    none = F.lit(None).cast("string")
    row = lambda u, m, s, c: F.struct(u.alias("unit"), m.alias("modality"), s.alias("subunit"), c.alias("channel"))
    return (
        F.when((n >= 3) & field(2).isin(*MODALITIES), row(unit(2), field(2), none, field(1)))
        .when((n >= 4) & field(3).isin(*MODALITIES), row(unit(3), field(3), field(2), field(1)))
        .when(n == 3, row(unit(2), field(2), none, field(1)))
        .when(n == 4, row(unit(3), field(3), field(2), field(1)))
    )
