"""Lineage of tables: transformation blocks from HTML documents, and upstream chains."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Edges of a connected part that reach_in_parts() leaves to one task; larger parts take the rounds of reach().
PART_EDGES = 8192
#: Edges of whole parts that a task takes.
TASK_EDGES = 1 << 19
#: Cells (a target and a table of its part) that a task holds at once, and pairs in a batch that it returns.
CELLS, PAIRS = 1 << 21, 1 << 18
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def plain_text(html: Column) -> Column:
    """Text of HTML without tags, entities of the five basic characters resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section, row, cells): the rows of all tables, under the last h2 heading before them."""
    sections = F.filter(F.split(html, r"(?i)<h2\b[^>]*>"), lambda s: F.length(s) > 0)
    parts = pages.select(key, F.posexplode(sections).alias("section_no", "part"))
    name = plain_text(F.regexp_extract("part", r"(?is)^(.*?)</h2>", 1))
    rows = parts.select(key, name.alias("section"), "section_no", F.posexplode(F.regexp_extract_all("part", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain_text)
    return rows.select(key, "section", "section_no", "row", cells.alias("cells"))


def upstream(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(target, source, hops, path) of every chain that leads to a target; edges are (source, target), roots (target).

    Chains are followed until none goes on, whatever their length: each hop joins the written frontier of the last one with the
    edges.  A chain never visits a table twice, so cycles end it.  Without roots every table is a target.  Rows with a null end
    are no edges.  There are as many rows as simple paths; where only what is reached counts, reach() is far cheaper.
    """
    e = written(edges.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s is not null and t is not null and s <> t").distinct())
    level = e.select(F.col("t").alias("target"), F.col("s").alias("source"), F.lit(1).alias("hops"), F.array("t", "s").alias("path"))
    if roots is not None:
        level = level.join(roots.select("target").distinct(), "target", "left_semi")
    out = level = written(level)
    while level.limit(1).count():
        level = level.join(e, level.source == e.t).where(~F.array_contains("path", F.col("s")))
        level = written(level.select("target", F.col("s").alias("source"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("s")).alias("path")))
        out = out.unionByName(level)
    return out


def reach(edges: DataFrame) -> DataFrame:
    """(target, source, hops): every table upstream of each, with the length of the shortest chain; none is upstream of itself.

    Doubling: after round k all pairs of at most 2**k hops are known.  A pair of up to twice as many has a table on its way that is
    exactly 2**k hops from the target, so a round joins only the pairs of that length with all known ones, and writes only what
    it finds.  It ends when no pair of that length goes on, as none is longer then; chains of n hops take log2(n) + 1 rounds and cycles end.
    Tables are numbered for the rounds; the names come back at the end.
    """
    e = written(edges.select("target", "source").where("source is not null and target is not null and source <> target").distinct())
    names = written(e.select(F.explode(F.array("target", "source")).alias("name")).distinct().select("name", F.monotonically_increasing_id().alias("number")))
    # a name stands in one row of names, so a table of its rows is never larger for a frequent one

    def coded(df: DataFrame, given: str, wanted: str) -> DataFrame:
        for c in ("target", "source"):
            own = names.select(F.col(given).alias("__given"), F.col(wanted).alias("__wanted")).hint("shuffle_hash")
            df = df.join(own, F.col(c) == F.col("__given")).withColumn(c, F.col("__wanted")).drop("__given", "__wanted")
        return df

    known, length = written(coded(e, "name", "number").withColumn("hops", F.lit(1))), 1
    heads = written(known.select(F.col("target").alias("head")).distinct())
    onward = lambda df: df.where(F.col("hops") == length).join(heads, F.col("source") == F.col("head"), "left_semi")
    front = onward(known)
    while front.limit(1).count():
        first = front.select(F.col("target").alias("end"), F.col("source").alias("middle"))
        on = first.join(known, first.middle == known.target).select(F.col("end").alias("target"), "source", (F.col("hops") + length).alias("hops")).where("target <> source")
        # known pairs are shorter than all that are found now
        found = known.unionByName(on).groupBy("target", "source").agg(F.min("hops").alias("hops")).where(F.col("hops") > length)
        found, length = written(found), length * 2
        known, front = known.unionByName(found), onward(found)
    return coded(known, "number", "name").select("target", "source", "hops")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is run within go when its own job ends; what it wrote stays."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _near(batches):
    """mapInArrow over the edges (target, source, a, b), with the hashes of both: (target, source, part); edges that others of their batch connect have the same part."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        a, b = at[: batch.num_rows], at[batch.num_rows :]
        label, before = np.arange(len(ids)), None
        while before is None or not np.array_equal(label, before):
            before = label.copy()
            least = np.minimum(before[a], before[b])
            for end in (a, b, before[a], before[b]):
                np.minimum.at(label, end, least)
            label = label[label]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids[label[a]])], ["target", "source", "part"])


def _connected(links: DataFrame) -> DataFrame:
    """(id, part) of every number in links (a, b); numbers that links connect have the same part.

    Each round gives a number the least of itself and its neighbours, puts these in place of the ends of all links and drops the
    links that are within one then, until none is left.  They are hashed anew for each round, so about half of a
    chain's go in a round, in whatever order they stand.  Two that become one by chance only put their parts together.
    """
    steps = []
    while not steps or links.limit(1).count():
        both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("id", "near"))
        least = both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.xxhash64(F.least("id", "near"), F.lit(len(steps))).alias("part"))
        steps.append(least)
        for c in ("a", "b"):
            links = links.join(least.select(F.col("id").alias(c), F.col("part").alias("__part")), c).withColumn(c, F.col("__part")).drop("__part")
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = steps.pop()
    while steps:
        onward = found.select(F.col("id").alias("__id"), F.col("part").alias("__part"))
        found = steps.pop().join(onward, F.col("part") == F.col("__id"), "left").select("id", F.coalesce("__part", "part").alias("part"))
    return found


def _pairs_within(targets: np.ndarray, sources: np.ndarray, parts: np.ndarray):
    """(targets, sources, hops) of all pairs that edges between numbered tables lead to, in batches; parts has each edge's part.

    A breadth-first walk from many targets at once.  A target has a cell for each table of its part, and what is walked from it at one
    distance is no more than the part's edges; so targets are taken in blocks of CELLS of the greater of both.
    """
    n = int(max(targets.max(), sources.max())) + 1
    part = np.empty(n, np.int64)
    edges_of = np.bincount(parts)
    part[targets] = part[sources] = parts
    tables_of = np.bincount(part)
    by_part = np.argsort(part, kind="stable")
    place = np.empty(n, np.int64)  # of a table among those of its part
    place[by_part] = np.arange(n) - np.repeat(np.cumsum(tables_of) - tables_of, tables_of)
    before = sources[np.argsort(targets, kind="stable")]
    degree = np.bincount(targets, minlength=n)
    first = np.cumsum(degree) - degree
    roots = by_part[degree[by_part] > 0]
    load = np.cumsum(np.maximum(tables_of, edges_of)[part[roots]])
    start = 0
    while start < len(roots):
        end = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + CELLS, "right")))
        block = roots[start:end]
        start = end
        width = tables_of[part[block]]
        row_at = np.cumsum(width) - width
        seen = np.zeros(int(width.sum()), bool)
        owner = np.empty(len(seen), np.int32)
        seen[row_at + place[block]] = True
        row, table, hops, held, n_held = np.arange(len(block)), block, 0, [], 0
        while len(row):
            hops += 1
            steps = degree[table]
            at = np.repeat(first[table] - (np.cumsum(steps) - steps), steps)
            at += np.arange(len(at))
            row, table = np.repeat(row, steps), before[at]
            cell = row_at[row] + place[table]
            new = np.flatnonzero(~seen[cell])
            row, table, cell = row[new], table[new], cell[new]
            # of several ways of one length to a table one is kept
            owner[cell] = np.arange(len(cell), dtype=np.int32)
            one = np.flatnonzero(owner[cell] == np.arange(len(cell), dtype=np.int32))
            row, table, cell = row[one], table[one], cell[one]
            seen[cell] = True
            held.append((block[row], table, np.full(len(row), hops, np.int32)))
            n_held += len(row)
            if n_held >= PAIRS or not len(row):
                out = [np.concatenate(c) for c in zip(*held)]
                for k in range(0, n_held, PAIRS):
                    yield [c[k : k + PAIRS] for c in out]
                held, n_held = [], 0


def _reached(batches):
    """mapInArrow over the edges (target, source, part) of whole parts, sorted by part: (target, source, hops)."""

    def pairs(edges):
        edges = pa.Table.from_batches(edges).combine_chunks()
        named = pa.chunked_array([*edges["target"].chunks, *edges["source"].chunks]).combine_chunks().dictionary_encode()
        numbers = named.indices.to_numpy()
        parts = np.unique(edges["part"].to_numpy(), return_inverse=True)[1]
        for t, s, hops in _pairs_within(numbers[: len(edges)], numbers[len(edges) :], parts):
            yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(t)), named.dictionary.take(pa.array(s)), pa.array(hops)], ["target", "source", "hops"])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").to_numpy()
        start = int(np.searchsorted(parts, parts[-1]))  # of the last part, which may go on in the next batch
        if last is not None and last != parts[-1] or last is None and start:
            yield from pairs([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        last = parts[-1]
    if held:
        yield from pairs(held)


def reach_in_parts(edges: DataFrame) -> DataFrame:
    """The rows of reach(), for edges of many parts that no edge connects, as lineages of different data are.

    The parts are found first, by hashes of the names: two names of one hash only put their parts together.  What the edges of a batch
    connect is known at once, so only such parts as share a name with others take the rounds of _connected().  The edges of a part,
    PART_EDGES at most (repeated ones count), then meet in one task, which lists its pairs; nothing that is shuffled or written grows with
    the pairs.  Larger parts take the rounds of reach().
    """
    with _shuffles_dropped(edges.sparkSession):
        e = edges.where("source is not null and target is not null and source <> target")
        e = written(e.select("target", "source", F.xxhash64("target").alias("a"), F.xxhash64("source").alias("b")).mapInArrow(_near, "target string, source string, part long"))
        ends = e.select(F.explode(F.array(F.xxhash64("target"), F.xxhash64("source"))).alias("id"), "part")
        shared = written(ends.groupBy("id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("id", "a"))
        found = _connected(written(ends.join(shared, "id").select("a", F.col("part").alias("b")).where("a <> b").distinct()))
        onward = found.select(F.col("id").alias("part"), F.col("part").alias("__part")).hint("shuffle_hash")  # a row for each id
        parts = written(e.join(onward, "part", "left").select("target", "source", F.coalesce("__part", "part").alias("part")))
        large = written(parts.groupBy("part").count().where(F.col("count") > PART_EDGES).select("part"))
        n_large = large.count()
        # never more rows than edges / PART_EDGES
        within = parts.join(F.broadcast(large), "part", "left_anti").select(*parts.columns) if n_large else parts
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, parts.count() // TASK_EDGES)
        out = within.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_reached, "target string, source string, hops int")
        return out.unionByName(reach(parts.join(F.broadcast(large), "part", "left_semi"))) if n_large else out


def layer_counts(nodes: DataFrame) -> DataFrame:
    """The summary of a graph: tables of each layer."""
    return nodes.groupBy("layer").agg(F.count("*").alias("n_tables"))


# fixed values of the document format: headings that are no descriptions, what headings of sections and files say, titles of texts
HEADINGS = ("Destination Indexes", "Source", "SQL", "Transformations")
NUMBERED, SECTION, FILE = r"^\d+/\d+\)", r"(?U)^\d+/\d+\)\s+Repertoire\s+'(\w+)'$", r"^\d+/\d+\)\s+Fichier\s+'([^']+)'$"
TEXTS = {"sql": "SQL", "transformation_code": "Transformations", "where_filter": "Clause WHERE"}
KEY = "Clé primaire:"

_ELEMENTS = r"(?is)<(h[1245]|t[dh]|pre)\b[^>]*>(.*?)</\1>|<tr\b[^>]*>"
_BREAK = r"<br\s*/?>"


def _filled(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _text(body: Column) -> Column:
    """What stands in an element, without tags and white space around it."""
    return _stripped(_bare(body))


def elements(df: DataFrame, html: str, column: str) -> DataFrame:
    """df with a document's headings, cells and texts in place of it, in their order, and an element for each start of a table
    row: array<tag, body, text>.

    A tag is told by its first two letters (pr: pre).  text is a heading's text, and of a head cell what stands before its line
    break; other elements have none.
    """

    def opened(x: Column) -> Column:
        tag = F.lower(F.substring(x, 2, 2))
        start = F.instr(x, ">")  # of an element that isn't closed the body is empty
        closing = F.when(tag == "pr", 6).otherwise(5)
        return F.struct(tag.alias("tag"), F.substring(x, start + 1, F.greatest(F.length(x) - start - closing, F.lit(0))).alias("body"))

    def read(x: Column) -> Column:
        label = _bare(F.regexp_replace(x["body"], f"(?is){_BREAK}.*", ""))
        return F.struct(x["tag"].alias("tag"), x["body"].alias("body"), F.when(x["tag"] == "th", label).when(x["tag"].startswith("h"), _text(x["body"])).alias("text"))

    found = F.transform(F.transform(F.regexp_extract_all(html, F.lit(_ELEMENTS), F.lit(0)), opened), read)
    return df.select(*(c for c in df.columns if c != html), found.alias(column))


def _parts(column: str) -> Column:
    """The elements in a column that say something, each by what it is: array<kind, value, cells>.

    What an element is depends on its tag, its text and its neighbours alone, so each is judged once, whatever is asked of the
    runs it gets into.
    """

    def after_label(x: Column) -> Column:
        return F.when(x["body"].rlike(f"(?i){_BREAK}"), _text(F.regexp_extract(x["body"], f"(?is)^.*?{_BREAK}(.*)$", 1)))

    def labelled(x: Column, label: str) -> Column:
        return (x["tag"] == "th") & (x["text"] == label)

    def part(kind: str, value: Column | None = None, cells: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(kind).alias("kind"), (none.cast("string") if value is None else value).alias("value"), (none.cast("array<string>") if cells is None else cells).alias("cells"))

    def judged(x: Column, i: Column) -> Column:
        tag, text, near = x["tag"], x["text"], lambda k: F.get(column, i + k)
        is_row = (near(1)["tag"] == "td") & (near(2)["tag"] == "td") & (near(3)["tag"] == "td") & ~F.coalesce(near(4)["tag"] == "td", F.lit(False))
        out = F.when((tag == "tr") & is_row, part("column", None, F.transform(F.slice(column, i + 2, 3), lambda y: _text(y["body"]))))
        out = out.when((tag == "h1") & text.rlike(SECTION), part("section", F.regexp_extract(text, SECTION, 1)))
        out = out.when((tag == "h2") & text.rlike(NUMBERED), part("block", text))
        out = out.when((tag == "h4") & (F.length(x["body"]) > 0) & ~x["body"].contains("\n"), part("about", text))
        out = out.when((tag == "h5") & text.startswith(KEY), part("primary", text))
        out = out.when(labelled(x, "Source") & labelled(near(1), "Destination"), part("source", after_label(x)))
        out = out.when(labelled(x, "Destination") & labelled(near(-1), "Source"), part("target", after_label(x)))
        for name, title in TEXTS.items():
            out = out.when((tag == "pr") & (near(-1)["tag"] == "h4") & (near(-1)["text"] == title), part(name, _bare(_stripped(x["body"]))))
        return out

    return F.filter(F.transform(column, judged), lambda x: x.isNotNull())


def _runs(df: DataFrame, column: str, kind: str, number: str) -> DataFrame:
    """A row for each run of the parts in a column, from one of the kind to the next; those before the first are in none."""
    at = F.filter(F.sequence(F.lit(0), F.size(column) - 1), lambda i: F.get(column, i)["kind"] == kind)
    df = df.withColumn("at", at)  # a step of its own, or each run would look for all again
    runs = F.transform("at", lambda i, k: F.slice(column, i + 1, F.coalesce(F.get("at", k + 1), F.size(column)) - i))
    return df.select(*(c for c in df.columns if c not in ("at", column)), F.posexplode(runs).alias(number, column))


def _class_or_table(name: Column, file: Column) -> Column:
    """Of "class 'x' extends 'y'" x in the schema that the file's name begins with; other names as they are."""
    words = F.split(name, "'")
    is_class = (F.trim(words[0]) == "class") & (F.trim(F.get(words, F.lit(2))) == "extends")
    schema = F.when(file.contains("."), F.concat(F.substring_index(file, ".", 1), F.lit(".")))
    return F.when(is_class, F.concat(F.coalesce(schema, F.lit("")), F.get(words, F.lit(1)))).otherwise(name)


def _by_file(file: Column, otherwise: Column) -> Column:
    """The source that a file "schema.N_source_to_target.java" is named by; otherwise, if its name says nothing."""
    named = r"^([^.]*)\.(?:_?\d+_)?([^.]*?)_to_"
    return F.when(file.rlike(named), F.concat_ws(".", F.regexp_extract(file, named, 1), F.regexp_extract(file, named, 2))).otherwise(otherwise)


def _column_rows() -> Column:
    """The table rows of three cells as (source, destination, type, comment); a destination may be "name (type)"."""
    typed = r"(?U)^([^\s(]+)\s*\((\w[\w\s,]*)\)"

    def column(x: Column) -> Column:
        cells = x["cells"]
        has = cells[1].rlike(typed)
        name, kind = F.regexp_extract(cells[1], typed, 1), F.trim(F.regexp_extract(cells[1], typed, 2))
        return F.struct(cells[0].alias("source"), F.when(has, name).otherwise(cells[1]).alias("destination"), F.when(has, kind).alias("type"), _filled(cells[2]).alias("comment"))

    return F.transform(F.filter("run", lambda x: x["kind"] == "column"), column)


def blocks(pages: DataFrame, key: str, html: str, skip: tuple[str, ...] = ("structure",)) -> DataFrame:
    """The transformations of documents, a row each, in their order (section_no, block_no).

    A document has sections (h1 "1/9) Repertoire 'name'") of blocks (h2 "1/9) Fichier 'name'").  Of each block: file,
    description, source_table, dest_table, columns (source, destination, type, comment), sql, transformation_code,
    where_filter and source_primary_key, null where it has none.  Documents without sections, and null ones, give no rows.

    A document is read once into elements(), and each of them judged once by its tag and its neighbours; sections and blocks are
    runs of these parts.  Nothing is shuffled, and a document is one row until its blocks are.
    """
    found = elements(pages.select(key, html), html, "all")
    found = found.select(key, _parts("all").alias("run"))
    sections = _runs(found, "run", "section", "section_no")
    sections = sections.withColumn("repertoire", F.col("run")[0]["value"]).where(~F.col("repertoire").isin(*skip))
    rows = _runs(sections, "run", "block", "block_no").withColumn("kinds", F.col("run.kind"))
    # in steps, so that no expression is evaluated again for each that names it
    first = lambda kind: F.get("run", F.array_position("kinds", kind).cast("int") - 1)["value"]
    rows = rows.withColumns({"file": _filled(F.regexp_extract(F.col("run")[0]["value"], FILE, 1)), "about": first("about"), "s": first("source"), "t": first("target"), "primary": first("primary"), **{name: first(name) for name in TEXTS}})
    rows = rows.withColumn("s", F.when(F.col("s").isin("class Parent", ""), _by_file(F.col("file"), F.col("t"))).otherwise(F.col("s")))
    return rows.select(
        key, "section_no", (F.col("block_no") + 1).alias("block_no"), "repertoire", "file",
        F.when(~F.col("about").isin("", *HEADINGS), F.col("about")).alias("description"),
        _class_or_table(F.col("s"), F.col("file")).alias("source_table"),
        _class_or_table(F.col("t"), F.col("file")).alias("dest_table"),
        _column_rows().alias("columns"),
        *(_filled(F.col(name)).alias(name) for name in TEXTS),
        F.get(F.split("primary", "'"), F.lit(1)).alias("source_primary_key"),
    )


def _by_prefix(table: Column, values: dict[str, str], otherwise: Column) -> Column:
    """The value of the first key that the table's schema begins with."""
    schema = F.when(table.contains("."), F.split(table, r"\.")[0])
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, value in values.items():
        out = out.when(schema.startswith(prefix), F.lit(value))
    return out.otherwise(otherwise)


def graph_nodes(found: DataFrame, key: str, layers: dict[str, str], systems: list[str], inherits: dict[str, str] | None = None) -> DataFrame:
    """(key, table, layer, system) of each table in the blocks of a document, as its first mention has it.

    A source is placed by its schema; a destination is in the layer of its section, which is its system too.  The base tables
    that inherits names for tables are nodes with them, placed by their schema.
    """
    found = found.withColumn("layer", F.coalesce(*[F.when(F.col("repertoire") == k, F.lit(v)) for k, v in layers.items()], F.lit("unknown")))
    section = F.col("layer")
    as_source = F.struct(F.col("source_table").alias("table"), _by_prefix(F.col("source_table"), layers, section).alias("layer"), _by_prefix(F.col("source_table"), {s: s for s in systems}, F.lit("unknown")).alias("system"))
    as_target = F.struct(F.col("dest_table").alias("table"), section.alias("layer"), F.col("repertoire").alias("system"))
    rows = found.select(key, "section_no", "block_no", F.posexplode(F.array(as_source, as_target)).alias("side", "t")).where("t.table <> ''")
    nodes = rows.groupBy(key, F.col("t.table").alias("table")).agg(F.min_by("t", F.struct("section_no", "block_no", "side")).alias("t")).select(key, "table", "t.layer", "t.system")
    nodes = written(nodes)  # named several times by what is made of them, and so by whoever takes them
    for child, base in (inherits or {}).items():
        b = F.lit(base)
        more = nodes.where(F.col("table") == child).select(key, b.alias("table"), _by_prefix(b, layers, F.lit("unknown")).alias("layer"), F.split(b, r"\.")[0].alias("system"))
        nodes = nodes.unionByName(more.join(nodes.select(key, "table"), [key, "table"], "left_anti"))
    return nodes


def graph_edges(found: DataFrame, nodes: DataFrame, key: str, inherits: dict[str, str] | None = None) -> DataFrame:
    """(key, source, target, file, description, n_columns): a block between two tables, and each class with its base.

    inherits names the base table of a table; such an edge is added where the table is a node and no block has it.
    """
    edges = found.where("source_table <> dest_table and source_table <> '' and dest_table <> ''").select(key, F.col("source_table").alias("source"), F.col("dest_table").alias("target"), "file", "description", F.size("columns").alias("n_columns"))
    edges = written(edges)
    for child, base in (inherits or {}).items():
        more = nodes.where(F.col("table") == child).select(key, F.lit(child).alias("source"), F.lit(base).alias("target")).join(edges.select(key, "source", "target"), [key, "source", "target"], "left_anti")
        edges = edges.unionByName(more.withColumn("n_columns", F.lit(0)), allowMissingColumns=True)
    return edges


def repaired(nodes: DataFrame, edges: DataFrame, key: str, final: str, staging: str, tables: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the tables of the final schema that are really those of the same name in staging.

    Such a table is none of the final schema's own, and staging has its name; edges from it start at the staging table, and it
    goes if no edge ends there.
    """
    short = F.substring_index("table", ".", -1)
    doubtful = nodes.where(F.col("table").startswith(f"{final}.") & ~short.isin(*tables)).select(key, F.col("table").alias("source"), F.concat(F.lit(f"{staging}."), short).alias("real"))
    moved = doubtful.join(nodes.select(key, F.col("table").alias("real")), [key, "real"])
    out = edges.join(moved, [key, "source"], "left").withColumn("source", F.coalesce("real", "source")).select(*edges.columns)
    ends = out.select(key, F.col("target").alias("source")).unionByName(out.select(key, "source"))
    gone = moved.join(ends, [key, "source"], "left_anti").select(key, F.col("source").alias("table"))
    return nodes.join(gone, [key, "table"], "left_anti"), out


def graph(found: DataFrame, key: str, layers: dict[str, str], systems: list[str], final: str, staging: str, tables: tuple[str, ...], inherits: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired nodes and edges of the blocks of documents, which are read once.

    Nodes and edges take the same blocks, so these are written between; as are nodes and edges by their own steps.
    """
    found = written(found.select(key, "section_no", "block_no", "repertoire", "file", "description", "source_table", "dest_table", "columns"))
    nodes = graph_nodes(found, key, layers, systems, inherits)
    return repaired(nodes, graph_edges(found, nodes, key, inherits), key, final, staging, tables)
