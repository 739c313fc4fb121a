"""Annotated features: attributes, hierarchy, spans and stitched coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.prefix import global_prefix
from strandline.operators.ranges import merged
from strandline.operators.scratch import stored

def attributes(df: DataFrame, keys: Sequence[str], text: str = "attrs") -> DataFrame:
    """(keys..., name, values): ``k=v,v;k=v`` as rows; values of a repeated name together, in
    the order in which they stand."""
    item = F.posexplode(F.split(text, ";")).alias("at", "kv")
    name, values = F.trim(F.split_part("kv", F.lit("="), F.lit(1))), F.split(F.expr("substring(kv, instr(kv, '=') + 1)"), ",")
    rows = df.select(*keys, item).where("kv like '%=%'").select(*keys, name.alias("name"), F.struct("at", values.alias("values")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["values"])
    return rows.groupBy(*keys, "name").agg(F.flatten(ordered).alias("values"))


def with_attribute_map(df: DataFrame, text: str = "attrs") -> DataFrame:
    """``df`` with ``attributes``, the map of attribute names to their values, made row by row:
    no row is shuffled for it.  Without ``k=v`` the map is empty, without text it is null."""
    item = lambda kv: F.struct(F.trim(F.substring_index(kv, "=", 1)).alias("name"), F.split(F.substr(kv, F.instr(kv, "=") + 1), ",").alias("values"))
    items = df.withColumn("items__", F.transform(F.filter(F.split(text, ";"), lambda kv: F.contains(kv, F.lit("="))), item))
    names = F.array_distinct(F.col("items__.name"))
    together = F.transform(names, lambda n: F.flatten(F.filter("items__", lambda i: i["name"] == n)["values"]))
    # Few texts repeat a name: in all others the items are the entries as they stand.
    once = F.size(names) == F.size("items__")
    return items.withColumn("attributes", F.when(once, F.map_from_entries("items__")).otherwise(F.map_from_arrays(names, together))).drop("items__")


def spelled(kind: Column, name: str, renamed: dict[str, dict[str, str]]) -> Column:
    """How a canonical attribute name is spelled for a feature type: its own, else that of all."""
    spelling = F.lit(renamed.get("all", {}).get(name, name))
    for feature, names in renamed.items():
        if feature != "all" and name in names:
            spelling = F.when(kind == feature, names[name]).otherwise(spelling)
    return spelling


def attribute(attrs: Column, kind: Column, name: str, renamed: dict[str, dict[str, str]]) -> Column:
    """Values of a canonical name whose spelling may differ by feature type or for all; none: an empty array."""
    return F.coalesce(F.try_element_at(attrs, spelled(kind, name, renamed)), F.array().cast("array<string>"))


def has_attribute(attrs: Column, kind: Column, name: str, values: Sequence[str], renamed: dict[str, dict[str, str]]) -> Column:
    """Whether at least one of ``values`` is a value of the attribute."""
    return F.arrays_overlap(attribute(attrs, kind, name, renamed), F.array(*[F.lit(v) for v in values]))


def standardised(attrs: Column, kind: Column, renamed: dict[str, dict[str, str]]) -> Column:
    """The map with canonical names in place of the spellings of ``renamed``."""

    def canonical(key: Column) -> Column:
        out = key
        for name, spelling in renamed.get("all", {}).items():
            out = F.when(key == spelling, name).otherwise(out)
        for feature, names in renamed.items():
            for name, spelling in names.items() if feature != "all" else ():
                out = F.when((kind == feature) & (key == spelling), name).otherwise(out)
        return out

    return F.transform_keys(attrs, lambda k, _: canonical(k))


def distinct_features(features: DataFrame) -> DataFrame:
    """Features that differ in any column but the line; attributes (a map) count by their sorted entries."""
    keys = [F.array_sort(F.map_entries(c)) if kind.startswith("map") else F.col(c) for c, kind in features.dtypes if c != "line_no"]
    row = F.row_number().over(Window.partitionBy(F.xxhash64(*keys), *keys).orderBy("line_no"))
    return features.withColumn("row__", row).where("row__ = 1").drop("row__")


def of_types(features: DataFrame, types: Sequence[str]) -> DataFrame:
    return features.where(F.col("type").isin(*types))


def with_ids(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Features whose ``id`` stands in ``ids`` (id)."""
    return features.join(ids.select("id").distinct(), "id", "left_semi")


def at_lines(features: DataFrame, lines: DataFrame) -> DataFrame:
    """Features of the line numbers in ``lines`` (line_no)."""
    return features.join(lines.select("line_no").distinct(), "line_no", "left_semi")


def sorted_features(features: DataFrame, attrs: str = "attrs") -> DataFrame:
    """By molecule in order of its first line, start, longest first, source, type, attributes."""
    first = features.groupBy("seqid").agg(F.min("line_no").alias("first__"))
    return features.join(first, "seqid").orderBy("first__", "start", F.desc("end"), "ann_source", "type", attrs).drop("first__")


def subfeatures(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Features one of whose parents is in ``ids`` (id)."""
    child = features.withColumn("parent", F.explode("parents"))
    return child.join(ids.select(F.col("id").alias("parent")), "parent").select(*features.columns).dropDuplicates(["id"])


def closure(features: DataFrame, roots: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(root, id, level): all features below the roots, level by level until none is new;
    cycles end because known pairs are not followed again.  ``types`` keeps the features of
    these types (column ``type``) in the result; the way to them may lead over others."""
    edges = stored(features.select(F.explode("parents").alias("parent"), F.col("id").alias("child")), "edges")
    seen = stored(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level")).distinct(), "closure")
    last, level = seen, 0
    while True:
        level += 1
        new = last.join(edges, last["id"] == edges["parent"]).select("root", F.col("child").alias("id")).distinct()
        new = stored(new.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("level", F.lit(level)), "closure")
        if new.isEmpty():
            break
        seen, last = seen.unionByName(new), new
    if types is None:
        return seen
    return seen.join(features.where(F.col("type").isin(*types)).select("id").distinct(), "id", "left_semi").select("root", "id", "level")


def subset_annotation(features: DataFrame, genes: DataFrame) -> DataFrame:
    """The features of ``genes`` (id) and all that lie below them."""
    ids = closure(features, with_ids(features, genes).select("id")).select("id").distinct()
    return features.join(ids, "id", "left_semi")


def feature_spans(parts: DataFrame, keys: Sequence[str], complete: bool = True) -> DataFrame:
    """(keys..., start, end): the whole span of a feature's parts, or their union as ranges."""
    return parts.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end")) if complete else merged(parts, keys)


def from_genomic(start: Column, end: Column, f_start: Column, f_end: Column, strand: Column) -> tuple[Column, Column]:
    """Range within a feature, counted along its strand."""
    minus = strand == "-"
    return F.when(minus, f_end - end).otherwise(start - f_start), F.when(minus, f_end - start).otherwise(end - f_start)


def to_genomic(start: Column, end: Column, f_start: Column, f_end: Column, strand: Column) -> tuple[Column, Column]:
    minus = strand == "-"
    return F.when(minus, f_end - end).otherwise(start + f_start), F.when(minus, f_end - start).otherwise(end + f_start)


def coding_phase(parts: DataFrame, key: str) -> DataFrame:
    """Parts of a coding sequence with the bases before them modulo 3."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("phase", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)) % 3)


def stitched_ranges(parts: DataFrame, key: str) -> DataFrame:
    """Parts with their range in the concatenation of all parts of their key."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0))
    return parts.withColumn("part_start", at).withColumn("part_end", F.col("part_start") + F.col("end") - F.col("start"))


def gene_groups(coding: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene_id, cds_id, orphan): coding sequences with the gene that their id names before
    its last dot.  orphan: ``cds`` without a gene (or without a dot), ``gene`` without a
    coding sequence, else null."""
    named = coding.select("cds_id", F.nullif(F.regexp_extract("cds_id", r"^(.+)\.[^.]+$", 1), F.lit("")).alias("named"))
    both = named.join(genes.select("gene_id"), F.col("named") == F.col("gene_id"), "full")
    return both.select(F.coalesce("gene_id", "named").alias("gene_id"), "cds_id", F.when(F.col("gene_id").isNull(), "cds").when(F.col("cds_id").isNull(), "gene").alias("orphan"))


def genes_of_coding(coding: DataFrame, genes: DataFrame) -> DataFrame:
    """Reference coding rows (seq_id, source, gene) with the gene row of their source and gene."""
    return coding.join(genes.select(F.col("seq_id").alias("gene_seq_id"), "source", "gene"), ["source", "gene"])


def appearance_order(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, first_line, index): keys numbered from 0 by their first line."""
    first = df.groupBy(key).agg(F.min(line).alias("first_line"))
    return global_prefix(first, ["first_line", key], []).withColumnRenamed("row_before", "index")
