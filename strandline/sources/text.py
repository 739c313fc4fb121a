"""Readers and writers of FASTA, GFF3, BED, hit tables, guide maps and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.targets import with_target_lengths

HSP = "query_id string, subject_id string, ident_pct double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, gaps int, qlen int, btop string, nident int"


def _fasta_records(rows: DataFrame) -> DataFrame:
    """(seq_id, seq, len) of records without the ``>`` before them; the last of equal ids wins."""
    rows = rows.where("trim(value) != ''").withColumn("ord", F.monotonically_increasing_id())
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("seq_id"), body.alias("seq"), "ord")
    last = rows.groupBy("seq_id").agg(F.max_by("seq", "ord").alias("seq"))
    return last.withColumn("len", F.length("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq, len): the id is the text up to white space.  Records part at a ``>``
    that begins a line, so descriptions may hold one."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    return _fasta_records(rows.select(F.regexp_replace("value", "^>", "").alias("value")))


def read_gff_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of the FASTA section of a GFF3 file; none without the section.  The
    record before the first sequence holds the features: it begins with ``#`` or with a
    feature line."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    features = F.col("value").startswith("#") | (F.size(F.split(F.substring_index("value", "\n", 1), "\t")) >= 9)
    return _fasta_records(rows.where(~features))


def write_fasta(df: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "seq", wrap: int = 60) -> None:
    wrapped = F.rtrim(F.regexp_replace(seq_col, f"(.{{{wrap}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat(F.lit(">"), id_col, F.lit("\n"), wrapped)).write.mode("overwrite").text(path)


def parsed_gff(lines: DataFrame, value: str = "value") -> DataFrame:
    """Nine typed columns; starts from 0, ends exclusive, dots are null."""
    f = F.split(value, "\t")
    text = lambda i: F.nullif(f[i], F.lit("."))
    return lines.where(~F.col(value).startswith("#") & (F.size(f) >= 9)).select(
        f[0].alias("seqid"), f[1].alias("ann_source"), f[2].alias("type"), (f[3].cast("int") - 1).alias("start"), f[4].cast("int").alias("end"),
        text(5).cast("double").alias("score"), f[6].alias("strand"), text(7).cast("int").alias("phase"), F.array_join(F.slice(f, 9, 1000), "\t").alias("attrs"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows up to an embedded FASTA section, whose lines have too few fields."""
    return parsed_gff(spark.read.text(path))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of a ten-column BED table made from GFF3: the columns of ``read_gff``."""
    f = F.split("value", "\t")
    text = lambda i: F.nullif(f[i], F.lit("."))
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 10)).select(
        f[0].alias("seqid"), f[6].alias("ann_source"), f[7].alias("type"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"),
        text(4).cast("double").alias("score"), f[5].alias("strand"), text(8).cast("int").alias("phase"), F.array_join(F.slice(f, 10, 1000), "\t").alias("attrs"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """BED or GFF3 by the file's extension."""
    return (read_bed if path.lower().endswith(".bed") else read_gff)(spark, path)


def gff_line(seqid: Column, source: Column, kind: Column, start: Column, end: Column, score: Column, strand: Column, phase: Column, attrs: Column) -> Column:
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    return F.concat_ws("\t", seqid, source, kind, (start + 1).cast("string"), end.cast("string"), dot(score), strand, dot(phase), attrs)


def write_gff(features: DataFrame, path: str, sequences: DataFrame | None = None) -> None:
    """Feature lines of nine columns; positions from 1, ends included, nulls as dots; with
    ``sequences`` (seq_id, seq) a FASTA section after them, in files that sort last."""
    c = [F.col(n) for n in ("seqid", "ann_source", "type", "start", "end", "score", "strand", "phase", "attrs")]
    lines = features.select(gff_line(*c).alias("value"), F.lit(0).alias("part"), F.lit("").alias("id"))
    if sequences is None:
        lines.select("value").write.mode("overwrite").text(path)
        return
    mark = features.sparkSession.createDataFrame([("##FASTA", 1, "")], "value string, part int, id string")
    records = sequences.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("value"), F.lit(2).alias("part"), F.col("seq_id").alias("id"))
    lines.unionByName(mark).unionByName(records).orderBy("part", "id").select("value").write.mode("overwrite").text(path)


def write_bed(features: DataFrame, path: str) -> None:
    """Ten columns: place, ID attribute, score, strand, source, type, phase, attributes."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    name = F.regexp_extract("attrs", "(?:^|;)ID=([^;]*)", 1)
    line = F.concat_ws("\t", "seqid", F.col("start").cast("string"), F.col("end").cast("string"), name, dot("score"), dot("strand"), dot("ann_source"), dot("type"), dot("phase"), F.coalesce("attrs", F.lit("")))
    features.select(line).write.mode("overwrite").text(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hit table with starts from 0 and the strand apart from the coordinates."""
    raw = spark.read.schema(HSP).option("sep", "\t").csv(path)
    minus = F.col("sstart") > F.col("send")
    return raw.withColumns({"strand": F.when(minus, "-").otherwise("+"), "qstart": F.col("qstart") - 1, "sstart": F.least("sstart", "send") - 1, "send": F.greatest("sstart", "send")})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("sep", "," if path.endswith(".csv") else "\t").csv(path)


def read_map(spark: SparkSession, path: str, targets: DataFrame | None = None) -> DataFrame:
    """Guide maps of all layouts, with any user checks after the set column, as a map of
    nullable booleans.

    The newest layouts name the target's length and the set; older ones lack the length or
    call the set ``group``; the oldest holds one half-open range ``[start, end)`` from 0.
    ``targets`` (target_id, seq) gives lengths that a map lacks, and overrides those it has;
    the rest is 0.
    """
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    cols = rows.columns
    last = next(i for i, c in enumerate(cols) if c.lower() in ("set", "group"))
    value = lambda c: F.when(F.lower(F.col(f"`{c}`")) == "pass", True).when(F.lower(F.col(f"`{c}`")) == "fail", False)
    checks = F.create_map(*[x for c in cols[last + 1 :] for x in (F.lit(c), value(c))]) if cols[last + 1 :] else F.create_map().cast("map<string,boolean>")
    text = lambda c: F.col(f"`{c}`")
    size = F.coalesce(text("target length").cast("int"), F.lit(0)) if "target length" in cols else F.lit(0)
    whole = next((c for c in cols if "exclusive" in c.lower()), None)
    start = F.regexp_extract(text(whole), r"\[(\d+), *(\d+)\)", 1).cast("int") if whole else text("start").cast("int") - 1
    end = F.regexp_extract(text(whole), r"\[(\d+), *(\d+)\)", 2).cast("int") if whole else text("end").cast("int")
    out = rows.select(text("gRNA id").alias("grna_id"), F.upper(text("gRNA sequence")).alias("grna"), text("target id").alias("target_id"), size.alias("target_len"), text("target sense").alias("sense"), text("gRNA strand").alias("strand"), start.alias("start"), end.alias("end"), text(cols[last]).alias("set"), checks.alias("checks"))
    return out if targets is None else with_target_lengths(out, targets).select(*out.columns)


def map_rows(hits: DataFrame, checks: list[str], version: int = 5) -> DataFrame:
    """The columns of a guide map, in one of its layouts: 5 (the newest) and 4 have a set, 5
    and 3 the target's length, 3 and 2 a group, 1 a half-open range from 0."""
    c = [F.when(F.col("checks")[n], "pass").when(~F.col("checks")[n], "fail").otherwise("NA").alias(n) for n in checks]
    if version not in (1, 2, 3, 4, 5):
        raise ValueError(f"no such layout: {version}")
    length = [F.col("target_len").alias("target length")] if version in (3, 5) else []
    place = [F.concat(F.lit("["), "start", F.lit(", "), "end", F.lit(")")).alias("range (start inclusive, end exclusive)")] if version == 1 else [(F.col("start") + 1).alias("start"), F.col("end")]
    group = F.col("set").alias("set" if version in (4, 5) else "group")
    return hits.select(F.col("grna_id").alias("gRNA id"), F.col("grna").alias("gRNA sequence"), F.col("target_id").alias("target id"), *length, F.col("sense").alias("target sense"), F.col("strand").alias("gRNA strand"), *place, group, *c)


def write_map(hits: DataFrame, path: str, checks: list[str], version: int = 5) -> None:
    """Sorted by set, guide, target and start; positions from 1, ends included."""
    map_rows(hits.orderBy("set", "grna_id", "target_id", "start"), checks, version).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_outputs(kind: str, folder: str, guides: DataFrame, hits: DataFrame, groups: DataFrame, positions: DataFrame, checks: list[str], names: DataFrame | None = None) -> list[str]:
    """The map, FASTA and equivalents of one kind of result (all, pass or final), and their paths."""
    if kind not in ("all", "pass", "final"):
        raise ValueError(f"no such kind of result: {kind!r}")
    paths = [f"{folder}/gRNA_{kind}.{ext}" for ext in ("map", "fasta", "eqv")]
    write_map(hits, paths[0], checks)
    write_guides(guides, paths[1], names)
    write_tsv(equivalents(groups, positions, guides), paths[2])
    return paths


def named_guides(guides: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(grna_id, grna), with the ids that ``names`` (seq_id, seq) has for the same sequences;
    of several the smallest."""
    if names is None:
        return guides.select("grna_id", "grna")
    new = names.groupBy(F.upper("seq").alias("grna")).agg(F.min("seq_id").alias("name"))
    return guides.join(new, "grna", "left").select(F.coalesce("name", "grna_id").alias("grna_id"), "grna")


def write_guides(guides: DataFrame, path: str, names: DataFrame | None = None, only: DataFrame | None = None) -> None:
    """FASTA of guides (grna_id, grna), renamed by ``names``; ``only`` (grna_id or grna) selects some."""
    if only is not None:
        by = "grna_id" if "grna_id" in only.columns else "grna"
        guides = guides.join(only.select(by).distinct(), by, "left_semi")
    write_fasta(named_guides(guides, names).distinct().orderBy("grna_id"), path, "grna_id", "grna")


def equivalents(groups: DataFrame, positions: DataFrame, guides: DataFrame) -> DataFrame:
    """Guides of equal coverage, largest coverage first and nearest to 5' first within a
    group; ``groups`` (cg, grna, n_targets), ``positions`` (grna, pos), ``guides`` (grna_id, grna)."""
    rows = groups.select("cg", "grna", "n_targets").join(positions, "grna").join(guides, "grna").orderBy(F.desc("n_targets"), "cg", "pos", "grna_id")
    return rows.select(F.col("cg").alias("coverage group"), F.col("n_targets").alias("coverage"), F.col("grna_id").alias("gRNA id"), F.col("grna").alias("gRNA sequence"), (F.floor(F.col("pos") * 100 + 0.5) / 100).alias("relative pos"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def mask_report(files: DataFrame, masked: DataFrame) -> DataFrame:
    """(value): a comment line for each file (alias, fname), the header, and the masked
    regions (fname, molecule, start, end, masked) under their alias; starts stay from 0."""
    named = files.select(F.lit(0).alias("part"), F.concat(F.lit("#"), "alias", F.lit("\t"), "fname").alias("value"))
    fixed = files.sparkSession.createDataFrame([(-1, "#alias\tfname"), (1, "source\tmolecule\tstart\tend\tmasked")], "part int, value string")
    text = lambda c: F.col(c).cast("string")
    rows = masked.join(files, "fname").select(F.lit(2).alias("part"), F.concat_ws("\t", "alias", "molecule", text("start"), text("end"), "masked").alias("value"))
    return fixed.unionByName(named).unionByName(rows).orderBy("part", "value").select("value")


def write_mask_report(files: DataFrame, masked: DataFrame, path: str) -> None:
    mask_report(files, masked).write.mode("overwrite").text(path)


def lookup(rows: DataFrame, aliases: str, value: str, sep: str = ";") -> DataFrame:
    """(alias, value): one row for each alias of a multi-key line."""
    return rows.select(F.explode(F.split(aliases, sep)).alias("alias"), F.col(value).alias("value"))


def inverse_lookup(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("value").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
