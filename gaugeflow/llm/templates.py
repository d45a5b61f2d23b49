"""Line dedup with a log-template tree, with DataFrame functions only.

A line is parsed as in a fixed-depth log tree: first by its number of tokens, then by its ``DEPTH`` leading
tokens. Tokens that hold a digit are variable fields (``<*>``). The fields of a line are its tokens, however long it is.

A leaf of the tree holds any number of templates. A field is constant where ``MIN_DOCS`` documents of the leaf have it at
that place, and variable otherwise; lines with the same constant and variable fields share a template, if beyond the leading
tokens at least ``LEAST_CONSTANT`` fields are constant and these are ``ALIKE`` of the fields there that hold no digit. Other
lines, short sentences that merely begin alike among them, stand for their own masked tokens. A template that occurs in at least
``MIN_DOCS`` documents is boilerplate: its lines are dropped from all documents but the first
(smallest doc_id), which keeps one copy of what it says.

Lines are parted by newlines; blank lines have no template and stay. Null texts stay null, empty ones empty. Rows
that repeat a whole row count as one document and are treated alike; null ids come last. Further
columns are kept, but for ``n_lines`` and ``n_dropped`` of ``dedup_lines``, which replaces columns of these names. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import passing_tables, row_key, stash
from gaugeflow.llm.sketch import bind

DEPTH = 3
LEAST_CONSTANT = 4
ALIKE = 0.6
MIN_DOCS = 3
VARIABLE = "<*>"


def tokens(line: Column) -> Column:
    """Tokens of a line with the variable fields masked."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", VARIABLE)).otherwise(line)
    return F.filter(F.split(masked, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def parse(t: Column, depth: int = DEPTH) -> Column:
    """Template and leaf of the tokens of a line; null for a blank one."""
    return F.when(F.size(t) > 0, F.struct(F.xxhash64(t).alias("template"), F.xxhash64(F.size(t), F.slice(t, 1, depth)).alias("leaf")))


def parsed_lines(docs: DataFrame, key: Column, depth: int = DEPTH) -> DataFrame:
    """(row_key, doc_id, template, leaf): each template of a document once."""
    lines = F.array_distinct(F.array_compact(F.transform(F.split(F.col("text"), "\n"), lambda line: bind(tokens(line), lambda t: parse(t, depth)))))
    return docs.where(F.col("text").isNotNull()).select(key.alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(lines).alias("line")).select("row_key", "doc_id", "line.*")


def members(docs: DataFrame, key: Column, templates: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(template, leaf, docs, fields): the templates of leaves that hold several of them, with a hash for each field.

    Only these need their fields, so the lines are read again, each template from the first document that has it.
    """
    leaves = templates.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("variants")).where((F.col("leaf_docs") >= min_docs) & (F.col("variants") > 1)).select("leaf")
    wanted = templates.join(leaves, "leaf").groupBy(F.col("first.row_key").alias("__key")).agg(F.collect_list(F.struct("template", "leaf", "docs")).alias("__wanted"))
    rows = docs.select(key.alias("__key"), "text").join(wanted, "__key").dropDuplicates(["__key"])
    # a struct (template, fields) for each line, its fields only where the template is wanted here
    names = F.col("__wanted.template")
    read = F.transform(F.split("text", "\n"), lambda line: bind(tokens(line), lambda t: F.when(F.array_contains(names, F.xxhash64(t)), F.struct(F.xxhash64(t).alias("template"), F.transform(t, lambda x: F.xxhash64(x)).alias("fields")))))
    each = rows.select("__wanted", F.explode(F.array_distinct(F.array_compact(read))).alias("line"))
    own = F.filter("__wanted", lambda w: w["template"] == F.col("line.template"))[0]
    return each.select(own.alias("own"), "line.fields").select("own.*", "fields").hint("rebalance", "leaf")


def generalised(found: DataFrame, depth: int = DEPTH, alike: float = ALIKE, min_docs: int = MIN_DOCS, least: int = LEAST_CONSTANT) -> DataFrame:
    """(template, wider): the template with constant and variable fields, of those that have one, from ``members``.

    A cell is a field at a place of a leaf. Cells are counted in one shuffle; of a cell that too few documents have,
    the smallest and the largest template are all that have it (with more than two, it comes from a join). A template is
    known by its leaf and the sum (xor) of the hashes of its constant cells: all of its cells but the rare ones.
    """
    cells = F.transform("fields", lambda x, i: F.xxhash64(F.col("leaf"), i, x))
    is_plain = lambda x, i: (i >= depth) & (x != F.xxhash64(F.lit(VARIABLE)))
    whole = found.select(
        "template", "leaf", F.size("fields").alias("size"), F.size(F.filter("fields", is_plain)).alias("plain"),
        F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(c)).alias("all_cells"),
    )
    each = found.select("template", "leaf", "docs", F.posexplode("fields").alias("pos", "field"))
    each = each.select("template", "docs", F.xxhash64("leaf", "pos", "field").alias("cell"), is_plain(F.col("field"), F.col("pos")).alias("plain"))
    rare = each.groupBy("cell").agg(F.sum("docs").alias("n"), F.max("plain").alias("plain"), F.min("template").alias("low"), F.max("template").alias("high")).where(F.col("n") < min_docs)
    if min_docs > 3:
        rare = each.join(rare.select("cell"), "cell")
    else:
        rare = rare.select("cell", "plain", F.explode(F.array_distinct(F.array("low", "high"))).alias("template"))
    rare = rare.groupBy("template").agg(F.bit_xor("cell").alias("cells"), F.count("*").alias("n"), F.count_if("plain").alias("n_plain"))
    none = F.lit(0).cast("long")
    variable, constants = F.coalesce("n", none), F.col("plain") - F.coalesce("n_plain", none)
    chosen = whole.join(rare, "template", "left").where((constants >= least) & (constants >= alike * F.col("plain")))
    return chosen.select("template", F.xxhash64("leaf", F.col("size") - variable, F.col("all_cells").bitwiseXOR(F.coalesce("cells", none))).alias("wider"))


def recurring(docs: DataFrame, key: Column, lines: DataFrame, depth: int = DEPTH, alike: float = ALIKE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(template, keeper): the templates to drop, and the document that keeps its lines; ``lines`` are those of ``parsed_lines``."""
    doc = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))
    templates = stash(lines.groupBy("template").agg(F.count_distinct("row_key").alias("docs"), F.min(doc).alias("first"), F.max("leaf").alias("leaf")), "templates")
    with passing_tables(docs.sparkSession):
        found = stash(members(docs, key, templates, depth, min_docs), "members")
        wider = stash(generalised(found, depth, alike, min_docs), "wider")
    groups = lines.select("template", "row_key", "doc_id").join(wider, "template").groupBy("wider").agg(F.count_distinct("row_key").alias("docs"), F.min(doc).alias("first")).where(F.col("docs") >= min_docs)
    by_leaf = wider.join(groups, "wider").select("template", F.col("first.row_key").alias("keeper"))
    alone = templates.where(F.col("docs") >= min_docs).select("template", F.col("first.row_key").alias("keeper")).join(by_leaf.select("template"), "template", "left_anti")
    return by_leaf.unionByName(alone)


def _without(docs: DataFrame, depth: int = DEPTH, alike: float = ALIKE, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with __all, its lines, and __kept, those that stay (null: all)."""
    key = row_key(docs)
    with passing_tables(docs.sparkSession):
        lines = stash(parsed_lines(docs, key, depth), "lines")
        drop = lines.select("row_key", "template").join(recurring(docs, key, lines, depth, alike, min_docs), "template").where(F.col("row_key") != F.col("keeper"))
        drop = stash(drop.groupBy(F.col("row_key").alias("__key")).agg(F.collect_list("template").alias("__drop")), "dropped")
    rows = docs.withColumn("__key", key).join(drop, "__key", "left")
    kept = F.filter("__all", lambda line: ~F.coalesce(F.array_contains(F.col("__drop"), F.xxhash64(tokens(line))), F.lit(False)))
    return rows.withColumn("__all", F.split(F.col("text"), "\n")).withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept)).drop("__key", "__drop")


def _text() -> Column:
    return F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines of recurring templates; adds n_lines and n_dropped."""
    rows = _without(docs, **options)
    n = F.coalesce(F.size("__all"), F.lit(0))
    n_lines = F.when(F.col("text").isNotNull(), n).otherwise(0).alias("n_lines")
    n_dropped = F.when(F.col("__kept").isNotNull(), n - F.size("__kept")).otherwise(0).alias("n_dropped")
    own = [_text().alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*own, n_lines, n_dropped)


def documents_without_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """The documents that have text left or lost none, with all their columns; n_chars, where there is one, follows the text."""
    rows = _without(docs, **options)
    rows = rows.where(F.col("__kept").isNull() | (F.trim(_text()) != ""))
    changed = {"text": _text(), "n_chars": F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.char_length(_text()).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else None}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
