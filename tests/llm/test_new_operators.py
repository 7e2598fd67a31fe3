"""Fill in the middle, source divergence and line dedup against plain versions, on edge cases, and with their SQL on made tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import fill_middle, language_id, line_dedup, mixing, queries, source_divergence
from skein.llm.chat_format import conversations

DOCS = "doc_id long, text string, lang string, source string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = ["Über", "ÉCOLE", "naïve", "x1", "日本語", "KelvinK", "don't", "A", "bb", "𝒳y", "CCC", "İs"]
    common = ["  Subscribe NOW\t", "subscribe now", "Terms & conditions", "\x0b page \r", "é", "É"]
    out = []
    for i in range(70):
        lines = [r.choice(common) if r.random() < 0.4 else " ".join(r.choice(vocabulary) for _ in range(r.randrange(6))) for _ in range(r.randrange(7))]
        out.append((i, "\n".join(lines), r.choice(["de", "fr", None, "", "xx"]), r.choice(["hot", "hot", "b", "C", None, "é"])))
    out += [(100, None, "de", "b"), (101, "", None, None), (102, "\n", "de", "hot"), (103, "\n\n", "de", "C"), (104, "no end\nof line", "fr", "b"), (105, "has <M> in it\n", "fr", "b"), (106, "<P\n>S>\n<S", "fr", "b"), (3, out[3][1], "fr", "C"), (3, "other\ntext", "fr", "C"), (None, "no id\nx", "fr", "C"), (None, "no id\nx", "fr", "C"), (-5, "1 2 3", "numbers", "b"), (107, "4 5", "numbers", "C"), (108, "word " * 30_000 + "\n" + "é\n" * 30_000, "fr", "long"), (109, "x" * 200_000, "de", "b")]
    out += [(200 + k, "one line in a third of all\n  mine " + str(k), "de", "hot") for k in range(45)] + [(7_000, "twice\nin a row", "de", "hot")] * 30
    r.shuffle(out)
    return out


def split_units(text, unit):
    if unit == "char":
        return list(text)
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else re.findall(r"^[\t-\r ]+|[^\t-\r ]+[\t-\r ]*", text)


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("word", 60, 30), ("char", 100, 100)])
def test_fill_in_middle(spark, rows, unit, rate, spm):
    df = spark.createDataFrame(rows, DOCS).withColumn("N", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("other", F.col("doc_id"))
    made = fill_middle.fill_in_middle(df, unit=unit, rate=rate, spm=spm)
    got = Counter((x.doc_id, x.text, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.back) for x in made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect())
    assert made.columns == ["doc_id", "text", "lang", "source", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = Counter()
    for i, t, _, _ in rows:
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        u = split_units(t or "", unit)
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            want[i, t, len(u), "plain", None, None, t or "", t or ""] += 1
        else:
            form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
            want[i, t, len(u), form, len(p), len(m), out, t] += 1
    assert got == want and len({x[3] for x in want}) == (2 if spm == 100 else 3)
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_bits():
    r = random.Random(3)
    for width in (1, 2, 3, 64, 65, 1000):
        bits = [k for k in range(width) if r.random() < 0.4] or [0]
        mask = sum(1 << k for k in bits)
        assert [fill_middle.nth_bit(mask, k, width) for k in range(len(bits))] == bits
    assert fill_middle.unit_starts(b"") == 0 and fill_middle.unit_starts(b"a\n\nb\n") == 0b01101


@pytest.mark.parametrize("marks", [("<a>", "<a>", "<b>"), ("ab", "ba", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")])
def test_marks_must_not_overlap(spark, marks):
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(spark.createDataFrame([], DOCS), marks=marks)


def plain_divergence(rows, least=3, most=200):
    occurs, held, groups = defaultdict(Counter), defaultdict(Counter), {((g or ""), (s or "")) for _, _, g, s in rows}
    for _, t, g, s in rows:
        terms = [lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        occurs[g or "", s or ""].update(terms)
        held[g or ""].update(set(terms))
    out = []
    for g in {g for g, _ in groups}:
        sources = sorted(s for lang, s in groups if lang == g)
        kept = [w for w, n in held[g].items() if n >= least]

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // (total + len(kept)) for w in kept}

        whole = shares(sum((occurs[g, s] for s in sources), Counter()))
        by = {s: shares(occurs[g, s]) for s in sources}
        for s in sources:
            pair = [(sum((by[s][w] - by[o][w]) ** 2 // by[o][w] for w in kept), o) for o in sources if o != s]
            term = [((by[s][w] - whole[w]) ** 2 // whole[w], w) for w in kept if occurs[g, s][w] and by[s][w] > whole[w]]
            for part, found, top in (("pair", pair, len(pair)), ("term", term, most)):
                out += [(g, s, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,most", [(3, 200), (1, 4)])
def test_source_divergence(spark, rows, least, most):
    df = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("clash")).withColumn("v", F.lit(9)).withColumn("item", F.lit(None).cast("string"))
    got = sorted(map(tuple, source_divergence.source_divergence(df, least_docs=least, most_terms=most).collect()))
    want = plain_divergence(rows, least, most)
    assert got == want
    assert ("numbers", "C", "pair", "b", 0, 1) in got  # a language without terms
    assert source_divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    counts = [(9_000_000_000_000_000, 90_000_000_000_000_000, 12_345), (0, 0, 1), (5, 7, 3)]
    got = spark.createDataFrame(counts, "c long, t long, v long").select(source_divergence.share("c", "t", "v").alias("p")).collect()
    assert [x.p for x in got] == [1 + 10**9 * (c + 1) // (t + v) for c, t, v in counts]


@pytest.mark.parametrize("documents,chars,share", [(10, 1, 1000), (3, 5, 1000), (10, 1, 1)])
def test_line_dedup(spark, rows, documents, chars, share, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARE", share)
    key = lambda x: lower(x.strip("\t\n\x0b\x0c\r "))
    split = [(i, t, (t or "").split("\n")) for i, t, _, _ in rows]
    held = Counter(k for _, _, lines in split for k in {key(x) for x in lines})
    gone = {k for k, n in held.items() if n >= documents and len(k) >= chars}
    want = Counter()
    for i, t, lines in split:
        stay = [x for x in lines if key(x) not in gone]
        want[i, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    df = spark.createDataFrame(rows, DOCS).withColumn("N_LINES", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("a", F.lit(2)).withColumn("hot", F.lit(3))
    made = line_dedup.dedup_lines(df, documents=documents, chars=chars)
    assert made.columns == ["doc_id", "text", "lang", "source", "key", "a", "hot", "n_lines", "n_dropped"]
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in made.collect()) == want and len(gone) > 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_source_divergence", "op13_line_dedup"])
@pytest.mark.parametrize("empty", [False, True])
def test_queries_and_sql(spark, rows, tmp_path, name, empty):
    df = spark.createDataFrame(rows, DOCS)
    (df.limit(0) if empty else df).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(list, got.select(*want.columns).collect()))) == sorted(map(repr, map(list, want.fetchall())))


def test_line_dedup_is_native(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    assert "Python" not in line_dedup.dedup_lines(df)._jdf.queryExecution().toString()


def test_mix_is_the_same_under_any_setting(spark, tmp_path):
    """The words that each document gives don't depend on shuffle partitions, files or the order of rows."""
    r = random.Random(9)
    rows = [(i if i % 50 else None, " ".join(["w"] * r.randrange(300)), f"s{min(i % 7, 3)}") for i in range(1500)] + [(7, "a b", "tiny"), (8, "c d e", "tiny"), (9, "f", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen, held = set(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, files in ((1, 1), (4, 7), (8, 2), (200, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df.orderBy(F.rand(partitions)).repartition(files).write.parquet(f"{tmp_path}/{partitions}")
            made = mixing.mix_sources(spark.read.parquet(f"{tmp_path}/{partitions}"))
            seen.add(tuple(sorted((repr(g.doc_id), g.size, g.source, g.taken, repr(g.blocks)) for g in made.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(seen) == 1


def test_small_sources_are_drawn_from(spark):
    """A source of fewer words than a block gives words that the tree picks, not the first ones of its stream."""
    rows = [(i, " ".join(f"{i}.{k}" for k in range(9)), "a" if i < 40 else "b") for i in range(52)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    outs = []
    for seed in (1, 2, 3):
        got = mixing.mix_sources(df, weights=(1, 9), most=3, seed=seed).collect()
        outs.append({(g.doc_id, b["first"], b["words"]) for g in got for b in g.blocks if g.source == "a"})
        assert sum(g.taken for g in got if g.source == "a") == round(got[0].target if got[0].source == "a" else next(g.target for g in got if g.source == "a"))
    assert len(set(map(frozenset, outs))) == 3


def test_turns_with_gaps(spark, tmp_path):
    """A message without quotes replies to the last turn before it, also over a gap and from one stretch of turns to another."""
    rows = [("a", t, "user", f"says {t}") for t in (0, 2, 4, 999, 1000, 5000, 5001)] + [("b", 7, "user", "first"), ("b", 9, "bot", "> first\n\nyes"), ("b", 3000, "user", "later"), ("c", None, "user", "x"), (None, 3, "user", "y"), ("a", 2, "bot", "second part")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.root) for r in conversations(df).collect()}
    assert got == {("a", 0): (None, 0), ("a", 2): (0, 0), ("a", 4): (2, 0), ("a", 999): (4, 0), ("a", 1000): (999, 0), ("a", 5000): (1000, 0), ("a", 5001): (5000, 0), ("b", 7): (None, 7), ("b", 9): (7, 7), ("b", 3000): (9, 7), ("c", None): (None, None), (None, 3): (None, 3)}
    df.where("conv_id IS NOT NULL AND turn IS NOT NULL").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = duck.sql(queries.SQL["op5_chat_format"])
    made = queries.QUERIES["op5_chat_format"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(list, made))) == sorted(map(repr, map(list, want.fetchall())))


def test_training_sample_of_repeated_ids(spark):
    """Repeated ids are one document each, whatever the order of rows, and don't use up the sample."""
    rows = [(1, f"hot text {k}", "en") for k in range(200)] + [(k, f"text {k}", "en") for k in range(2, 40)] + [(1, "autre", "fr"), (None, "no id", "fr"), (5, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = set()
    for k in (1, 2, 3):
        got = language_id.sampled(df.orderBy(F.rand(k)).repartition(k * 3), "doc_id", "text", "lang", 30).collect()
        seen.add(tuple(sorted(map(repr, map(tuple, got)))))
    counts = Counter(r.lang for r in got)
    assert len(seen) == 1 and counts == {"en": 30, "fr": 2}  # a row without an id can't be told from others and takes no part
