"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct 3-word shingles. Two sets link when 100 * |intersection| >= ``PERCENT`` * |union|. Sets are ordered by
(number of documents that hold the shingle, hash), rarest first. Linked sets of n and m shingles then share one among the first
n - ceil(0.9 n) + 1 of each (the prefix), their sizes differ by a tenth at most, and at their first common shingle there must still be
enough left in both.

1. Document frequencies come from ``keycounts``; shingles held by one document only cannot be shared and are not posted.
2. Documents with equal sets form a class. Classes with the same size and prefix form a group, which is posted once.
3. Each group is verified against one other group only, the one that comes first under the group's commonest prefix
   shingle, and members of a group against its first member. Components of these links are taken.
4. Only where a prefix shingle joins different components are group pairs made. Of two linked sets the smaller one holds their first common
   shingle so early that its posting alone tells how large a partner may be; postings that allow none as large as the set itself are
   not indexed, and the others meet probes of their sizes only. Pairs are filtered by size and position, expanded to their members
   and verified. A pair within one component needs no check, as its link cannot change the components.
   So copies, near copies and texts around a common passage never give all their pairs.

Hot keys: a class that many pairs name and a shingle that many groups post are dealt into parts (see ``skew``). The links that are verified
span each component; other links within a component are not listed.

What is verified is counted on whole sets of 64-bit shingle hashes. The result is exact up to equal hashes of different shingles.

Defined cases: a null or empty text has no shingles, links with nothing and is its own component; a text with fewer than three words is one shingle;
repeated rows are equal sets; rows without an id are members but never name a component unless all are; other columns are not read.
``one_of_each`` hands on all columns; of rows with one id and text it keeps the first by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import keycounts
from emberlog.llm.components import roots
from emberlog.llm.runtime import grouped, materialize, paired, streamed
from emberlog.llm.skew import LEAST, MOST, salted_join
from emberlog.llm.textblock import large, row_ranges, windows, words_of

SHINGLE, PERCENT = 3, 90
#: Rows without a text or set that a task may get under one key.
NARROW = 1000
#: Rows of postings or pairs that a written file holds.
FILE_POSTINGS = 500_000
SHINGLED = "doc_id long, mark long, n long, class binary, prefix binary, tokens array<long>, positions array<int>, members binary"


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and where each text's begin (and the end)."""
    parts, counts = [], []
    for lo, hi in row_ranges(texts):
        found, first = windows(words_of(texts.slice(lo, hi - lo)), k)
        owner = np.repeat(np.arange(hi - lo), np.diff(first))
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        parts.append(found[new])
        counts.append(np.bincount(owner[new], minlength=hi - lo))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def shingled(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row of ``SHINGLED`` for each document; ``tokens`` (posted prefix shingles) and ``members`` (the set) once for each class and block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    n_blocks, n_buckets = keycounts.sizes(rows, "text", 0.2)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n_blocks)).cast("long"))

    def ask(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(shingle_sets(large(table["text"]), k)[0], return_counts=True)
        return pa.Table.from_batches(list(keycounts.ask(table["block"][0].as_py(), 1, keys, counts, n_buckets)))

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.split()[0]: [] for f in SHINGLED.split(", ")}
        sets, first = shingle_sets(large(table["text"]), k) if table.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        shared = keycounts.answer_for(answers, 1)[np.unique(sets, return_inverse=True)[1]] if len(sets) else np.zeros(0, np.int64)
        met: set[bytes] = set()
        for i, (doc, mark) in enumerate(zip(table["doc_id"].to_pylist(), table["mark"].to_pylist()) if table.num_rows else []):
            own, df = sets[first[i] : first[i + 1]], shared[first[i] : first[i + 1]]
            name, prefix, tokens, positions, members = None, None, None, None, None
            if len(own):
                raw = own.astype("<u8").tobytes()
                name = blake2b(raw, digest_size=16).digest()
                if name not in met:
                    met.add(name)
                    p = prefix_length(len(own), percent)
                    # the rarest p: nothing beyond the p-th frequency can be among them
                    near = np.flatnonzero(df <= np.partition(df, p - 1)[p - 1])
                    near = near[np.lexsort((own[near], df[near]))][:p]
                    posted = np.flatnonzero(df[near] > 1)
                    if len(posted):
                        prefix = blake2b(own[near].astype("<u8").tobytes(), digest_size=16, key=str(len(own)).encode()).digest()
                        tokens, positions, members = own[near[posted]].view(np.int64), posted.astype(np.int32), raw
            for column, value in zip(out, (doc, mark, len(own), name, prefix, tokens, positions, members)):
                out[column].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.Table.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    answers = keycounts.answered(rows.groupBy("block").applyInArrow(grouped(ask), keycounts.ASKED))
    return rows.groupBy("block").cogroup(answers.select("block", "bucket", "kind", "counts").groupBy("block")).applyInArrow(paired(read), SHINGLED)


def could_link(n: Column, at: Column, m: Column, bt: Column, percent: int = PERCENT) -> Column:
    """Size filter, and what is left from the common shingle at positions ``at`` and ``bt`` on."""
    q = percent + 100
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (q * F.least(n - at, m - bt) >= percent * (n + m))


def largest_partner(n: Column, at: Column, percent: int = PERCENT) -> Column:
    """The size that a set linked with one of ``n`` shingles has at most, if their first common shingle is at position ``at`` of the latter."""
    return F.least(F.floor((percent + 100) * (n - at) / percent) - n, F.floor(100 * n / percent))


def size_class(n: Column) -> Column:
    """Sizes within about a twentieth of each other."""
    return F.floor(F.log(n.cast("double")) / 0.05).cast("int")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows (a, b) of ``pairs`` (a written table) whose sets link. A class that very many pairs name is dealt into parts, and its set goes to each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    size = max(LEAST, n // MOST)
    full = pairs
    for side, name in (("a", "x"), ("b", "y")):
        full = salted_join(full, sets.select(F.col("class").alias(side), F.col("members").alias(name)), [side], size, pairs)
    # what is left is narrow: a few files, whatever the number of tasks that verify
    return full.select("a", "b", "x", "y").mapInArrow(streamed(run), "a binary, b binary").repartition(max(1, -(-n // FILE_POSTINGS)))


def linked_classes(table: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) for each class of a table ``SHINGLED`` that links with another; a written table."""
    held = table.where(F.col("members").isNotNull())
    sets = held.groupBy("class").agg(F.first("members").alias("members"))
    classes = materialize(held.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "tokens", "positions")]), "jaccard-classes", held.count())
    n_classes, n_postings = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    # a group: the classes with one size and prefix
    groups = classes.groupBy("prefix").agg(F.min("class").alias("head"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("positions").alias("positions"))
    posting = F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("positions").alias("at")))
    postings = groups.select("head", "prefix", "n", posting.alias("p")).select("head", "prefix", "n", F.col("p.token").alias("token"), F.col("p.at").alias("at"))
    postings = materialize(postings, "jaccard-postings", n_postings, FILE_POSTINGS)
    # the group that meets the shingle first has the fewest rare ones of its own: the middle of a cluster
    met = postings.groupBy("token").agg(F.min(F.struct("at", "n", "head")).alias("hub"), F.count(F.lit(1)).alias("n_groups")).where(F.col("n_groups") > 1)
    ways = salted_join(postings, met, ["token"], NARROW).where((F.col("head") != F.col("hub.head")) & could_link(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), percent))
    chosen = ways.groupBy("head").agg(F.max(F.struct("n_groups", "token", F.col("hub.head").alias("to"))).alias("w")).select(F.col("head").alias("a"), F.col("w.to").alias("b"))
    within = salted_join(classes.select("class", "prefix"), groups.select("prefix", "head"), ["prefix"], NARROW).where(F.col("class") != F.col("head")).select(F.col("class").alias("a"), F.col("head").alias("b"))
    links = materialize(verified(materialize(chosen.unionByName(within), "jaccard-pairs", 2 * n_classes), sets, percent), "jaccard-links")
    part = materialize(roots(links), "jaccard-parts", n_classes)
    # units: members of a group that are in one component so far
    owned = materialize(classes.join(part.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "jaccard-owned", n_classes)
    units = owned.groupBy("prefix", "root").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("positions").alias("positions"))
    posted = units.select("prefix", "root", "n", posting.alias("p")).select("prefix", "root", "n", F.col("p.token").alias("token"), F.col("p.at").alias("at"))
    posted = materialize(posted, "jaccard-units", n_postings, FILE_POSTINGS)
    mixed = posted.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where(F.col("r1") != F.col("r2")).select("token")
    most = largest_partner(F.col("n"), F.col("at"), percent)
    probes = materialize(salted_join(posted, mixed, ["token"], NARROW).withColumn("size", size_class(F.col("n"))), "jaccard-probes", n_postings, FILE_POSTINGS)
    index = probes.where(most >= F.col("n")).withColumn("size", F.explode(F.sequence(size_class(F.col("n")), size_class(most))))
    index = index.select("token", "size", *[F.col(c).alias(f"o_{c}") for c in ("prefix", "root", "n", "at")])
    smaller = (F.col("o_n") < F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_root") < F.col("root")))
    found = salted_join(probes, index, ["token", "size"], NARROW).where(smaller & (F.col("root") != F.col("o_root")) & could_link(F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at"), percent))
    unit_pairs = materialize(found.select("prefix", "root", "o_prefix", "o_root").distinct(), "jaccard-unit-pairs")
    if unit_pairs.isEmpty():
        return part
    member = owned.select("prefix", "root", F.col("class"))
    pairs = unit_pairs.join(member.withColumnRenamed("class", "a"), ["prefix", "root"]).select("a", F.col("o_prefix").alias("prefix"), F.col("o_root").alias("root"))
    pairs = materialize(pairs.join(member.withColumnRenamed("class", "b"), ["prefix", "root"]).select("a", "b"), "jaccard-pairs")
    late = materialize(verified(pairs, sets, percent), "jaccard-links")
    # late links join whole components: few beside the links before
    whole = owned.select(F.col("class").alias("node"), "root")
    ends = late.join(whole.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(whole.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select("ra", "rb")
    top = materialize(roots(ends, "ra", "rb"), "jaccard-tops")
    moved = salted_join(whole, top.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"]).select("node", F.col("top").alias("root"))
    tree = part.join(moved.select(F.col("node").alias("_moved")), F.col("node") == F.col("_moved"), "left_anti").unionByName(moved)
    return materialize(tree, "jaccard-roots", n_classes)


def components(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id (smallest id reachable by links), class_size (documents with the same set)
    and component (a name that is never null) for every row."""
    table = materialize(shingled(docs, text, k, percent), "jaccard-sets")
    tree = linked_classes(table, percent)
    classes = table.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("class_size"))
    lows = classes.join(tree.withColumnRenamed("node", "class"), "class").groupBy("root").agg(F.min("low").alias("component_id"))
    tops = salted_join(tree, lows, ["root"]).withColumnRenamed("node", "class")
    named = classes.join(tops, "class", "left").select("class", F.coalesce("root", "class").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), "class_size")
    rows = table.select("doc_id", "mark", F.col("n").alias("n_shingles"), "class")
    # very many copies may be of one class
    linked = salted_join(rows.where(F.col("class").isNotNull()), named, ["class"]).select("doc_id", "mark", "n_shingles", "component_id", "class_size", F.hex("root").alias("component"))
    name = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("mark").cast("string"))
    alone = rows.where(F.col("class").isNull()).select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), name.alias("component"))
    return linked.unionByName(alone)


def jaccard_components(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size for every row."""
    return components(docs, text, k, percent).select("doc_id", "n_shingles", "component_id", "class_size")


def one_of_each(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of the document with the smallest id of each component; of equal rows one stays.

    A document is known by its id and the hash of its text, so a repeated id with another text is another document.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = components(docs, text, k, percent).groupBy("component").agg(F.min_by(F.struct("doc_id", "mark"), order).alias("b"))
    best = best.select(F.col("b.doc_id").alias("_b_id"), F.col("b.mark").alias("_b_mark"))
    # the columns of docs travel in one struct, so none of their names can clash
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_mark"))
    kept = marked.join(best, F.col("_id").eqNullSafe(F.col("_b_id")) & (F.col("_mark") == F.col("_b_mark")), "left_semi")
    hashable = [F.to_json(F.col("_doc")[c]) if "map<" in kind or "variant" in kind else F.col("_doc")[c] for c, kind in docs.dtypes]
    first = F.row_number().over(Window.partitionBy("_id", "_mark").orderBy(F.xxhash64(*hashable)))
    return kept.withColumn("_n", first).where(F.col("_n") == 1).select("_doc.*")


def oracle_sql(k: int = SHINGLE, percent: int = PERCENT) -> str:
    """The rows of ``jaccard_components`` for ``documents`` in DuckDB's SQL, for distinct ids that are not null: all pairs that share a shingle, so for small tables."""
    shingle = " || ' ' || ".join(f"x[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= {k} THEN list_transform(range(1, len(x) - {k - 2}), lambda i: {shingle}) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS s FROM w),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
held AS (SELECT doc_id, n, count(*) OVER (PARTITION BY name) AS class_size FROM sizes)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id, coalesce(class_size, 1) AS class_size
FROM w LEFT JOIN held ON held.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id"""
