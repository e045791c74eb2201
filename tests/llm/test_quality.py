import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from emberlog.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum(c.isupper() for c in text), text.count("!"))


def test_counts_match_brute_force(edge, edge_rows):
    got = Counter((r["doc_id"], *[r[c] for c in Q.COUNTS]) for r in Q.with_counts(edge.select("doc_id", "text")).drop("text").collect())
    assert got == Counter((i, *brute(t)) for i, t, _ in edge_rows)


def test_verdicts_without_labels(edge, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {(r["doc_id"], r["n_words"]): r for r in Q.quality_rules(edge, labels).collect()}
    assert out[(1, 120)]["kept"] and not out[(2, 0)]["kept"] and out[(15, 120)]["base_failed"]
    assert Q.quality_rules(empty, labels).count() == 0
    kept = Q.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.where("doc_id in (2, 15)").count() == 0 and kept.where("doc_id = 13").count() == 2


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(500, 0), (500, 1), (1000, 2), (2000, 3), (5000, 10), (9000, 20), (500, 400)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", Q.binomial_tail(F.col("n"), F.col("k"), 0.004))
    for r in df.collect():
        expected = 1.0 if r["k"] >= r["n"] * 0.004 else exact_tail(r["n"], r["k"], 0.004)
        assert abs(r["p"] - expected) < 1e-9 * max(1, expected) + 1e-12 * expected
    huge = spark.createDataFrame([(10**9, 3_990_000)], "n long, k long").withColumn("p", Q.binomial_tail(F.col("n"), F.col("k"), 0.004)).first()["p"]
    assert 0 < huge < 1e-6


COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_exclaims long"


def table(spark, rows):
    """Rows (doc_id, lang, symbols, repeated words) of a hundred words and a thousand characters."""
    return spark.createDataFrame([(i, g, 100, 1000, s, 0, w, 10, 10, 0) for i, g, s, w in rows], COUNTS)


def level(n, ks, units):
    """The certified level by the definition, from the numbers that each level rejects."""
    best = 0
    for j, k in enumerate(ks, 1):
        if k >= n * Q.ALPHA or exact_tail(n, k, Q.ALPHA) > Q.DELTA / units:
            break
        best = j
    return best or None


def severity(symbols, repeats):
    return max(sum(s > c for c in Q.RULES[r][2]) for r, s in (("symbols", symbols), ("repeats", repeats * 10)))


def test_levels_match_the_definition(spark):
    r = random.Random(14)
    rows = []
    for lang, n in (("en", 1500), ("de", 330), ("fr", 120), ("es", 90), (None, 40), ("it", 3)):
        for _ in range(n):
            rows.append((len(rows), lang, int(r.random() ** 60 * 500), int(r.random() ** 60 * 49)))
    labels = [(i, 1) for i, g, *_ in rows if g != "it"] + [(0, 0), (1, 1), (1, 1)]
    rows += rows[:5] + [(0, "en", 450, 0)]  # repeated ids: one trial each, the worst row counts
    got = {x["stratum"]: (x["n_good"], x["level"]) for x in Q.certified(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), F.coalesce("lang", F.lit(""))).collect()}
    worst = {}
    for i, g, s, w in rows:
        if g != "it":
            worst[i] = (g or "", max(worst.get(i, ("", 0))[1], severity(s, w)))
    by = {}
    for g, s in worst.values():
        by.setdefault(g, []).append(s)
    ks = lambda xs: [sum(x > Q.LEVELS - j for x in xs) for j in range(1, Q.LEVELS + 1)]
    thin = by["fr"] + by["es"] + by[""]
    assert got == {"en": (1500, level(1500, ks(by["en"]), 3)), "de": (330, level(330, ks(by["de"]), 3)), None: (250, level(250, ks(thin), 3))}
    assert got["en"][1] > 0


def test_thin_strata_share_a_unit(spark):
    sizes = {"en": 214, "de": 45, "fr": 40}
    rows = [(i, g, 0, 0) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    bad = [(1000 + i, g, 390, 0) for i, g in enumerate(["en", "de", "fr", "xx", None])]
    counts, labels = table(spark, rows + bad), spark.createDataFrame([(i, 1) for i, *_ in rows] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    stratum = F.coalesce("lang", F.lit(""))
    cuts = Q.certified(counts, labels, stratum)
    # de and fr have too few good labels even together, so all good labels decide for them, and for strata without any
    assert {x["stratum"]: (x["n_good"], x["level"]) for x in cuts.collect()} == {"en": (214, 8), None: (299, 8)}
    out = {x["doc_id"]: (x["kept"], x["rejected_by"]) for x in Q.judge(counts, cuts, stratum).collect()}
    assert all(out[i] == (i < 1000, [] if i < 1000 else ["symbols"]) for i in out) and len(out) == 304
    # too few good labels in all: base verdicts only
    few = Q.certified(counts, labels.where("doc_id < 100"), stratum)
    assert few.where("level is not null").count() == 0 and Q.judge(counts, few, stratum).where("not kept").count() == 0


def test_a_rate_above_the_bound_certifies_nothing(spark):
    rows = [(i, "en", 450 if i % 40 == 0 else 0, 0) for i in range(4000)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows], "doc_id long, quality int")
    assert {x["level"] for x in Q.certified(table(spark, rows), labels, F.col("lang")).collect()} == {None}
    # what the base rules reject anyway is no false rejection of the levels
    rows = [(i, "en", 450 if i % 40 == 0 else 0, 60 if i % 40 == 0 else 0) for i in range(4000)]
    assert {x["level"] for x in Q.certified(table(spark, rows), labels, F.col("lang")).collect()} == {8}


def test_query_matches_sql(spark, tmp_path):
    """The whole operator against its SQL on a table with nulls, repeated rows and labels, and thin strata."""
    r = random.Random(3)
    docs = []
    for i in range(700):
        noise = 30 if i % 9 == 0 else 0
        text = " ".join("".join(r.choices("abcdéÜ!#", [9, 9, 9, 9, 3, r.random() * 3, r.random() / 5, noise], k=6)) for _ in range(r.randrange(40, 90)))
        text += "\n" + "\n".join([text[:40]] * r.choice([0, 0, 0, 1, 2]))
        docs.append((i, r.choice([text, text, text, None, text + " " + text[: len(text) // 3]]), r.choice(["en", "en", "en", "en", "de", None])))
    docs += docs[:20] + [(None, "x", "en")]
    labels = [(i, i % 9 != 0 and (docs[i][1] or "").count("\n") < 2) for i in range(650)] + [(5, 1), (5, 0), (None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(q)) for i, q in labels], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = Q.quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    ours = Counter(map(tuple, out.select(*sorted(out.columns)).collect()))
    assert ours == Counter(con.execute(f"SELECT {', '.join(sorted(out.columns))} FROM ({Q.oracle_sql()})").fetchall())
    assert out.where("rejected_by <> '' and not base_failed").count() > 0


def test_keep_good_uses_the_levels(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "de" if i % 2 else "fr") for i in range(400)]
    bad = [(5000 + i, " ".join(f"w{i}y{j}###" for j in range(60)), "de") for i in range(3)]
    docs = spark.createDataFrame(good + bad + [(9000, "one two three four five six seven eight nine ten " * 6, "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    assert {r["doc_id"] for r in Q.keep_good(docs, labels).select("doc_id").collect()} == {i for i, *_ in good}
