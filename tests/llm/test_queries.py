"""Every opN_ query and every stage of the pipeline against plain Python on small tables."""

import hashlib
import random
import re
from itertools import combinations
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from skyfix.llm import decontaminate, membership, near_copies, page_text, personal_data, pieces, quality_rules, shards, simhash, substrings, token_counts, web_archive
from skyfix.llm import queries as llm
from skyfix.llm.queries_pieces import model_path
from skyfix.llm.shared import table

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def given():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def words(text):
    return [w for w in re.split(f"[{SPACES}]+", text) if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grouped(items, linked):
    """The least member reachable from each."""
    home = {i: i for i in items}

    def find(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for a, b in combinations(items, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            home[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_op4(spark, given):
    def fingerprint(text):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in given.items()}
    home = grouped(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = by_id(llm.QUERIES["op4_simhash"](spark, SF).collect())
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", home[i]) for i in given}


def test_op6_and_op7(spark, given):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = by_id(llm.QUERIES["op6_sentencepiece"](spark, SF).collect())
    for i, t in given.items():
        ids = sp.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    rows = llm.QUERIES["op7_token_counts"](spark, SF).collect()
    assert len(rows) == len(given)


def test_op8(spark, given):
    rows = llm.QUERIES["op8_shards"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(given) and {r.law for r in rows} == {"bytes"}
    assert all(r.size == len(given[r.doc_id].encode()) + 8 and r.grown_shard is None for r in rows)
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_op9(spark, given):
    first = {}
    for i in sorted(given):
        w = words(given[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = by_id(llm.QUERIES["op9_substrings"](spark, SF).collect())
    for i, t in given.items():
        w = words(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    # Passages are the maximal runs of the same words.
    taken = {}
    for r in substrings.passages(table(spark, SF, "documents")).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.n_words
    assert taken == {i: r.n_removed for i, r in got.items() if r.n_removed}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, x):
    d = re.sub(r"[^0-9]", "", x)
    luhn = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text):
    return sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid(n, m.group()))


def test_op10(spark, given):
    got = by_id(llm.QUERIES["op10_personal_data"](spark, SF).collect())
    for i, t in given.items():
        spans = base_spans(t)
        assert got[i].base_sha256 == sha(",".join(f"{n}:{a}:{e}" for a, _, e, n in spans))
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(n == k for *_, n in spans) for k in BASE]
        listed = set(filter(None, got[i].spans.split(",")))
        assert {f"{n}:{a}:{e}" for a, _, e, n in spans} <= listed


def test_personal_data_overlaps_and_long_texts(spark):
    texts = [
        "sk_live_4242424242424242abcd and key = 'AbCd0123+/EfGh4567IjKl89MnOp==' end", "12 ab " * 60_000, "a@b.cd " * 40_000, "1 " * 50_000 + "1a", "x" * 300_000 + " token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", None, "",
    ]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string, base string")
    got = {r.doc_id: r for r in personal_data.find_spans(df).collect()}
    assert [(x.s, x.e) for x in got[0].spans if x.kind == "secret"] == [(0, 28), (40, 70)] and any(x.kind == "card" for x in got[0].base)
    assert len(got[2].base) == 40_000 and got[2].base[39_999].e == 279_999 and not got[5].spans and not got[6].spans
    clean = {r.doc_id: r for r in personal_data.redact(df).collect()}
    assert clean[0].text == "[SECRET] and key = '[SECRET]' end" and clean[2].text == "[EMAIL] " * 40_000
    assert clean[4].text == "x" * 300_000 + ' token = "[SECRET]"' and clean[5].text is None and clean[1].text == texts[1] and clean[1].base == "clash"


def tokens(text):
    return re.findall(r"\w+", text.lower())


def contaminated(text, item):
    """Whether some 13 aligned tokens, or the whole shorter item, agree in 80 %."""
    a, b = tokens(text), tokens(item)
    full = min(13, len(b))
    if not full:
        return False
    for shift in range(-len(b), len(a)):
        same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
        sums = np.cumsum([0, *same])
        if max(sums[full:] - sums[:-full]) >= ceil(0.8 * full):
            return True
    return False


def test_seeds_hit_every_allowed_pattern():
    for n in range(1, 13):
        allowed = n - ceil(decontaminate.SIMILARITY * n)
        assert all(any(not set(m) & set(gone) for m in decontaminate.masks_of(n)) for gone in combinations(range(n), allowed))
    for gone in combinations(range(13), 2):
        assert any(not {at + o for o in m} & set(gone) for m in decontaminate.MASKS for at in range(13 - decontaminate.SPAN + 1))


def test_op5_short_items_repeats_and_empty_tables(spark):
    r = random.Random(4)
    name = lambda: f"t{r.randrange(100_000)}"
    items = [" ".join(name() for _ in range(n)) for n in (1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 20)] + ["", None]
    texts = []
    for item in items[:12]:
        w = item.split()
        for _ in range(6):
            v = w.copy()
            for k in r.sample(range(len(w)), min(len(w), r.randrange(4))):
                v[k] = name()
            texts.append(" ".join([name() for _ in range(20)] + v + [name() for _ in range(20)]))
    texts += [items[3], items[3], None, "", items[6].upper()]
    docs = spark.createDataFrame([(i % 70, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, size int")
    bench = spark.createDataFrame([(i % 9, t) for i, t in enumerate([*items, items[11]])], "item_id long, text string")
    exp = {(i % 70, j % 9) for i, t in enumerate(texts) for j, x in enumerate([*items, items[11]]) if contaminated(t or "", x or "")}
    found = [(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench, least_tokens=1).collect()]
    assert set(found) == exp and len(found) == len(exp)
    # Rows are judged by id and text; a null id does not hide a passage.
    more = docs.union(spark.createDataFrame([(None, items[11], "c", 1), (None, "clean text", "c", 1), (3, "clean text", "c", 1)], docs.schema))
    kept = decontaminate.clean(more, bench, least_tokens=1)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.text or "") for x in kept.collect()) == sorted(
        [(i % 70, t or "") for i, t in enumerate(texts) if not any(contaminated(t or "", x or "") for x in items)] + [(-1, "clean text"), (3, "clean text")]
    )
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def test_columns_of_the_caller_survive(spark):
    rows = [(1, "a b c d e f", "x", "y", "z"), (1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x", "y", "z"), (None, "other words here", "x", "y", "z"), (None, "other words here", "x", "y", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _maybe string, _slot string, row string")
    for deduplicate in (near_copies.deduplicate, simhash.deduplicate):
        kept = deduplicate(df)
        assert kept.columns == df.columns and sorted(tuple(map(str, r)) for r in kept.collect()) == sorted(tuple(map(str, r)) for r in (rows[0], rows[4]))
    gone = df.where("doc_id = 2").select(membership.row_key("doc_id", "text").alias("key"))
    from skyfix.llm.shared import written

    assert membership.without(df, written(gone, "gone"), membership.row_key("doc_id", "text")).count() == 4


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    pages = table(spark, SF, "pages").limit(0)
    made = [
        page_text.extract(pages), quality_rules.ledger(docs), quality_rules.keep(docs), simhash.near_duplicates(docs), near_copies.deduplicate(docs), pieces.encode(docs, model_path(), decoded=True),
        token_counts.count_tokens(docs, ["a", "b"]), shards.assign(docs, 3), substrings.remove_repeats(docs), substrings.passages(docs), personal_data.find_spans(docs), personal_data.redact(docs),
        web_archive.parsed(web_archive.read_archive(*web_archive.write_archive(pages, "page_id", "url", "html"))),
    ]
    assert all(df.count() == 0 for df in made)


def test_stages_of_the_pipeline(spark, given):
    """Each stage on all that the one before kept, against plain Python."""
    import sentencepiece

    import corpus_pipeline

    docs = table(spark, SF, "documents")
    from skyfix.llm.shared import written

    # Quality: the rules, one by one.
    def fails(t):
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        windows = {}
        for k in range(len(w) - 4):
            windows.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeated = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
        chars = sum(map(len, w))
        return (
            len(w) < 10 or 100 * len(repeated) > 20 * len(w) or 100 * sum(c in "#*$%&|<>" for c in t) > 20 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
            or not 2 * len(w) <= chars <= 15 * len(w) or 100 * sum(c.isupper() for c in t) > 40 * chars
        )

    exp = {i: t for i, t in given.items() if not fails(t)}
    now = written(corpus_pipeline.quality(spark, docs, SF), "t")
    assert now.columns == docs.columns and {r.doc_id: r.text for r in now.collect()} == exp
    # Near copies: five-word sets of similarity 0.8.
    sets = {}
    for i, t in exp.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    home = grouped(sorted(sets), lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    exp = {i: t for i, t in exp.items() if home[i] == i}
    now = written(corpus_pipeline.near_duplicates(spark, now, SF), "t")
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == set(exp)
    # Passages of the benchmark.
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    grams = [{g for k in range(len(b) - 3) for g in [tuple(b[k : k + 4])]} for b in map(tokens, items)]

    def held(t):
        a = tokens(t)
        own = {tuple(a[k : k + 4]) for k in range(len(a) - 3)}
        return any(contaminated(t, x) for x, g in zip(items, grams) if own & g)  # 11 of 13 agree: some four in a row do

    exp = {i: t for i, t in exp.items() if not held(t)}
    now = written(corpus_pipeline.decontamination(spark, now, SF), "t")
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == set(exp)
    # Personal data: all base spans are replaced, texts without any span stay.
    spans = {r.doc_id: r.spans for r in personal_data.find_spans(now).collect()}
    now = written(corpus_pipeline.redaction(spark, now, SF), "t")
    redacted = {r.doc_id: r.text for r in now.collect()}
    for i, t in exp.items():
        assert {(a, e) for a, _, e, _ in base_spans(t)} <= {(x.s, x.e) for x in spans[i]}
        out, at = "", 0
        for x in spans[i]:
            if x.s >= at:
                out += t[at : x.s] + f"[{x.kind.upper()}]"
            at = max(at, x.e)
        assert redacted[i] == out + t[at:]
    # Token ids.
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    last = {r.doc_id: r for r in corpus_pipeline.tokens(spark, now, SF).collect()}
    assert {i: r.ids for i, r in last.items()} == {i: sp.encode(t) for i, t in redacted.items()}
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}


def test_items_too_short_convict_nothing(spark):
    docs = table(spark, SF, "documents")
    bench = spark.createDataFrame([(1, "the"), (2, "of the it that"), (3, None), (4, "one two three four five")], "item_id long, text string")
    assert decontaminate.clean(docs, bench).count() == docs.count()
    assert sorted(map(tuple, decontaminate.short_items(bench).collect())) == [(1, 1), (2, 4), (3, 0)]


ODD_NAMES = "`a.b` string, `Text` string, _maybe string, _row string, `doc.id` long, `the text` string, slot string, shard_ string"


def test_names_of_all_kinds_and_repeated_rows(spark, tmp_path):
    """Every operator over the same table: names with dots and clashes, repeated rows, null ids."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        long = " ".join(f"word{k % 997}" for k in range(60_000)) + "."
        given = [("x", "y", "m", "r", i, t, "s", "z") for i, t in [(1, "some words " * 9), (1, "some words " * 9), (1, "some words " * 9), (None, "mail me@here.org or not"), (None, "mail me@here.org or not"), (2, None), (3, ""), (4, long), (5, long + " more")]]
        df = spark.createDataFrame(given, ODD_NAMES)
        names = {"id_col": "doc.id", "text_col": "the text"}
        n = len(given)
        assert quality_rules.keep(df, text_col="the text").columns == df.columns and quality_rules.ledger(df, **names).count() == n
        clean = personal_data.redact(df, text_col="the text")
        assert clean.columns == df.columns and sorted(r["the text"] or "" for r in clean.collect())[2].startswith("mail [EMAIL]")
        assert personal_data.find_spans(df, **names).count() == n
        for deduplicate in (near_copies.deduplicate, simhash.deduplicate):
            kept = deduplicate(df, **names)
            assert kept.columns == df.columns and 4 <= kept.count() <= 5
        assert simhash.near_duplicates(df, **names).count() == n
        bench = spark.createDataFrame([(7, "word11 word12 word13 word14 word15 word16 word17 word18 word19")], "`item.id` long, `a.b` string")
        found = decontaminate.overlaps(df, bench, **names, item_col="item.id", item_text_col="a.b")
        assert {r.doc_id for r in found.collect()} == {4, 5}
        bench = bench.toDF("item_id", "text")
        assert decontaminate.clean(df, bench, **names).count() == n - 2
        assert pieces.encode(df, model_path(), **names).count() == n and token_counts.count_tokens(df, ["a", "b"], **names).count() == n
        left = {(r.doc_id, r.n_words): r.n_removed for r in substrings.remove_repeats(df, **names).collect()}
        assert left[5, 60_001] > 59_900 and left[4, 60_000] == 0
        assert shards.assign(df, 3, **names).count() == n
        shards.write_shards(df, str(tmp_path / "out"), 3, **names)
        back = spark.read.parquet(str(tmp_path / "out"))
        assert back.count() == n and set(back.columns) == {c if c != "slot" else "slot_" for c in df.columns} | {"shard", "slot"}
        made = web_archive.parsed(web_archive.read_archive(*web_archive.write_archive(df, "doc.id", "a.b", "the text")))
        assert made.count() == n
        text = page_text.extract(df, "doc.id", "the text", "a.b")
        assert text.count() == n
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_written_slots_are_the_assigned_ones(spark, tmp_path):
    rows = [(i % 5 if i % 7 else None, f"text {i % 3}" if i % 4 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    shards.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    places = lambda rows: sorted((r.shard, r.slot) for r in rows)
    rows = back.collect()
    assert places(rows) == places(shards.assign(df, 4).collect()) and {r.n for r in rows} == set(range(60))
    # Without repeated rows each record has its own place.
    df = df.dropDuplicates(["doc_id", "text"]).where("text is not null")
    shards.write_shards(df, str(tmp_path / "more"), 4)
    texts = {(r.doc_id, crc32(r.text.encode())): r.text for r in df.collect()}
    placed = sorted((r.shard, r.slot, str(r.doc_id), r.text) for r in spark.read.parquet(str(tmp_path / "more")).collect())
    assert placed == sorted((r.shard, r.slot, str(r.doc_id), texts[r.doc_id, r.text_crc32]) for r in shards.assign(df, 4).collect())
