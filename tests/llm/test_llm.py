"""The training-data operators against brute force on small fixtures."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from skyfix.llm import decontaminate, near_copies, page_text, personal_data, pieces, quality_rules, shards, simhash, substrings, token_counts, web_archive
from skyfix.llm.queries_pieces import model_path
from skyfix.llm.queries_quality import SQL_QUALITY, op3_quality_rules
from skyfix.llm.queries_token_counts import vocabulary
from skyfix.llm.queries_web_archive import SQL_ARCHIVE, op1_web_archive

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, bits string, spans string, _row int"


def docs(spark, texts):
    """Rows with odd texts and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n\t", "one", words(1, 300), words(1, 300), "x" * 20000, "é ü 😀 ▁ \x00 a", words(2, 3000, 5), " lead  and   gaps \n\n end "]


@pytest.mark.parametrize("query, sql", [(op3_quality_rules, SQL_QUALITY), (op1_web_archive, SQL_ARCHIVE)])
def test_sql(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = query(spark, SF).toPandas(), con.execute(sql).df()
    text = lambda f: sorted(tuple("~" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert text(a) == text(b)


def test_archive_gives_back_every_record(spark):
    rows = [(3, "u", "x\r\n\r\ny"), (1, "v", "x\r\n\r\ny"), (2, None, None), (5, "w", ""), (5, "w", ""), (None, "q", "x\r\n\r\ny"), (7, "é\r\nWARC-Type: response\r\nWARC-Refers-To: <urn:page:99>", "ü" * 9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    warc = web_archive.read_archive(*web_archive.write_archive(df, "page_id", "url", "html"))
    assert warc.count() == len(rows)
    got = {}
    for r in web_archive.parsed(warc).collect():
        head = dict(x.split(": ", 1) for x in r.header.strip().split("\r\n")[1:])
        if head["WARC-Type"] == "response":
            assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest) and int(head["Content-Length"]) == len(r.http) + len(r.payload)
        got.setdefault(head["WARC-Record-ID"], []).append((head["WARC-Type"], head.get("WARC-Refers-To"), r.payload_bytes, head.get("WARC-Target-URI")))
    assert got["<urn:page:1>"] == [("response", None, 6, "v")] and got["<urn:page:3>"] == [("revisit", "<urn:page:1>", 6, "u")]
    assert got["<urn:page:5>"] == [("revisit", "<urn:page:2>", 0, "w")] * 2 and got["<urn:page:none>"] == [("revisit", "<urn:page:1>", 6, "q")]
    assert got["<urn:page:7>"] == [("response", None, 18, "é%0D%0AWARC-Type: response%0D%0AWARC-Refers-To: <urn:page:99>")]
    assert web_archive.read_archive(*web_archive.write_archive(df.limit(0), "page_id", "url", "html")).count() == 0


def test_quality_counts_and_ablations(spark):
    got = {r.doc_id: r for r in quality_rules.ledger(docs(spark, ODD + ["a b c d e a b c d e f"])).collect()}
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[10].n_repeat_words == 10
    assert got[8].n_repeat_words > 0 and got[6].word_chars == 20000
    kept = quality_rules.keep(docs(spark, ODD))
    assert kept.columns == docs(spark, ODD).columns and {r.doc_id for r in kept.collect()} == {4, 5}
    cut = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs(spark, ODD))).collect()}
    assert cut["few_words"].n_failed >= 6 and cut["few_words"].n_kept == 2


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    u = rng.integers(-(2**62), 2**62, 400, dtype=np.int64)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(64, 4, replace=False):
            v[i] ^= np.int64(1 << int(b)) if b < 63 else np.int64(-(2**63))
    tables = simhash.golay_tables()
    assert all(set(a) & set(b) for a, b in zip(simhash.fuzzy_keys(u, tables), simhash.fuzzy_keys(v, tables)))


def test_simhash_components(spark):
    base = words(5, 200).split()
    texts = ODD + [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(0, 200, 5)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints, home = {}, list(range(len(texts)))
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for _ in texts:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    home[i] = home[j] = min(home[i], home[j])
    assert all(got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == home[i] for i in prints)
    assert {r.doc_id for r in simhash.deduplicate(docs(spark, texts)).collect()} == set(home)


def test_near_copies_at_the_similarity(spark):
    """Copies just above and below 0.8, a chain, a star of copies, equal sets; against all pairs."""
    import corpus_pipeline

    base, long = words(5, 200, 9000).split(), words(6, 200, 9000).split()
    changed = lambda w, places, tag: " ".join(f"{tag}{k}" if k in places else x for k, x in enumerate(w))
    texts = ODD + [" ".join(base)] + [changed(base, range(3, 3 + 40 * n, 40), f"n{n}x") for n in range(1, 6)]
    texts += [changed(base, {4 + k, 104 + k}, f"s{k}x") for k in range(0, 90, 3)]
    texts += [changed(long, set(range(0, 30 * k, 10)), "c") for k in range(7)] + [" ".join(base).upper(), "a b c", "A  b C"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    home = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or 10 * len(a & b) >= 8 * len(a | b):
                    home[i] = home[j] = min(home[i], home[j])
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == home
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, texts), SF).collect()} == set(home)
    assert near_copies.deduplicate(docs(spark, [])).count() == 0


def test_near_copies_link_by_fuzzy_hashing(spark):
    """Operator 4's keys find copies within four bits, and the sets of what they find are verified."""
    base = words(9, 400, 9000)
    bits = lambda t: simhash.fingerprint_bits(t.encode(), near_copies.WIDTH)
    near = next(t for t in (f"{base} {words(20 + k, 3, 9000)}" for k in range(100)) if 0 < (bits(t) ^ bits(base)).bit_count() <= simhash.MAX_BITS)
    texts = [base, near, words(10, 300, 9000), words(11, 300, 9000)]
    # The last one only claims to be near the third.
    claimed = int(np.uint64(bits(texts[2]) ^ 1).astype(np.int64))
    rows = near_copies.keyed_rows(docs(spark, texts), "doc_id", "text").withColumn("bits", F.when(F.col("doc_id") == 3, F.lit(claimed)).otherwise(F.col("bits")))
    classes = rows.select("node", "bits")
    sets = near_copies.sets_of(docs(spark, texts), "doc_id", "text", classes.select("node"))
    id_of = {bytes(r.node): r.doc_id for r in rows.collect()}
    found = {frozenset((id_of[bytes(r.a)], id_of[bytes(r.b)])) for r in near_copies.fuzzy_links(classes, sets).collect()}
    assert found == {frozenset((0, 1))}


def test_benchmark_passages_with_substitutions(spark):
    item = [f"t{k}" for k in range(30)]
    swapped = item[5:21].copy()
    swapped[4], swapped[11] = "zz", "yy"
    far = [w if k % 3 else "q" for k, w in enumerate(item)]
    texts = ["intro " + " ".join(item) + " end", "a b " + " ".join(swapped) + " c", " ".join(far), None, "", "Short " + words(9, 50)]
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, None), (9, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs(spark, texts), bench).collect()} == {(0, 7), (1, 7)}
    assert {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()} == {2, 3, 4, 5}


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = {r.doc_id: r for r in pieces.encode(docs(spark, ODD), model_path(), decoded=True).collect()}
    for i, t in enumerate(ODD):
        assert got[i].ids == sp.encode(t or "") and got[i].decoded == sp.decode(sp.encode(t or ""))
    back = pieces.decode(spark.createDataFrame([(1, sp.encode("round trip")), (2, None)], "doc_id long, ids array<int>"), model_path())
    assert {r.doc_id: r.text for r in back.collect()} == {1: "round trip", 2: ""}


def test_longest_match_counts(spark):
    vocab = vocabulary(model_path())
    known, longest = set(vocab), max(map(len, vocab))

    def brute(word):
        s, n, at = "▁" + word, 0, 0
        while at < len(s):
            k = next((k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in known), 0)
            n += 1 if k else len(s[at].encode())
            at += k or 1
        return n

    texts = ODD[:6] + ODD[7:] + ["unbelievably Donaudampfschifffahrt 日本語 ğüş"]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), vocab).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        assert (got[i].n_words, got[i].n_tokens) == (len(w), sum(map(brute, w)))


def test_shards(spark, tmp_path):
    texts = ODD * 3 + [words(k, 30) for k in range(300)] + ["same"] * 300 + [words(k // 2 + 900, 20) for k in range(200)]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id % 7 = 3"))  # repeated rows
    rows = shards.assign(df, 6).collect()
    sizes, slots, homes = [0] * 6, [[] for _ in range(6)], {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes.setdefault(t, set()).add(r.shard)
    assert len(rows) == df.count() and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    largest = max(r.size for r in rows)
    whole = {t: sum(r.size for r in rows if (texts[r.doc_id] or "").encode() == t) for t in homes}
    assert all(len(h) == 1 for t, h in homes.items() if whole[t] <= largest) and sum(w <= largest for w in whole.values()) > 400
    assert shards.assign(docs(spark, []), 6).count() == 0
    shards.write_shards(df, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r.shard: r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {i: len(s) for i, s in enumerate(slots)}


@pytest.mark.parametrize("group", [1, 3000, 1 << 20])
def test_repeated_windows(spark, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    shared = words(77, 70, 5000)
    texts = ODD + [f"{words(k, 40)} {shared} {words(k + 50, 30)}" for k in range(8)] + [shared, words(1, 300) + " tail", "For " * 130, "For " * 60]
    first, exp = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        exp[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert got == exp


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, x):
    d = re.sub(r"[^0-9]", "", x)
    luhn = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def test_personal_data(spark):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("aB.@-_%+ 0192837465()é😀\n") for _ in range(90)) for _ in range(300)] + ["".join(r.choice("0123456789 -.+") for _ in range(60)) for _ in range(300)]
    texts += ["1" * 30000, "a" * 30000 + "@b.c", "a@b.c_d@e.f", 'key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and +1 (389) 555-5010', "plain words 2020-01-02 and 1234"]
    got = {x.doc_id: x for x in personal_data.find_spans(docs(spark, texts)).select("doc_id", personal_data.listed("base").alias("b"), personal_data.listed("spans").alias("s")).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if valid(n, m.group()))
        assert got[i].b == ",".join(f"{n}:{a}:{e}" for a, _, e, n in found)
    assert "secret:7:47" in got[len(texts) - 2].s and got[len(texts) - 1].s == ""
    clean = {x.doc_id: x for x in personal_data.redact(docs(spark, texts)).collect()}
    assert "[SECRET]" in clean[len(texts) - 2].text and "[PHONE]" in clean[len(texts) - 2].text and clean[0].text is None and clean[4].text == texts[4] and clean[4].bits == "x"


def test_page_text(spark):
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        '<div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p>First   paragraph, with\nwords and more of them here.</p><p><b>Second one is here too.<br><p>Third.</p></article><footer>&copy; site</footer></body></html>'
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<!-- " * 50)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(df).collect()}
    assert got[1] == "A & B\nFirst paragraph, with words and more of them here.\nSecond one is here too.\nThird."
    assert got[2] == got[3] == got[4] == ""


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<html><head><title>t</title><body><article><p>Text</p></article>", ["Text"]),
        ("<head><meta charset=utf-8><title>t</title><p>Text</p>", ["Text"]),
        ("<head><title>t</title>Bare <b>text</b><p>Next", ["Bare text", "Next"]),
        ("<head><title>t</title><script>x</script><noscript>y</noscript></head><p>Text</p>", ["Text"]),
        ("<p>A</p><svg><p>B</p>", ["A", "B"]),
        ("<p>A</p><select><option>x<option>y<p>B</p>", ["A", "B"]),
        ("<p>A</p><object><object>x</object><p>B</p>", ["A", "x", "B"]),
        ("<p>A<svg><svg>x</svg>y</svg></p><select><option>z</select><p>B</p>", ["A x y", "B"]),
        ("<iframe><!-- </iframe><p>A</p><iframe><p>B</p><canvas><noscript><p>C</p>", ["A", "B", "C"]),
        ("<p>A</p><script>var <p>x</p>", ["A"]),
        ("<p>As <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> says.</p>", ["As E=m says."]),
    ],
)
def test_elements_left_open_hide_nothing_else(page, expected):
    assert [text for _, text, _ in page_text.blocks(page)] == expected


def test_article_below_a_head_left_open(spark):
    body = "<body><article><h1>A title</h1><p>First paragraph, with\nwords and more of them here.</p><p>Second one is here too, and it goes on.</p></article></body></html>"
    pages = [(1, "u", f"<html><head><title>T</title></head>{body}"), (2, "u", f"<html><head><title>T</title>{body}")]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert "First paragraph, with words" in got[1] and got[2] == got[1]


def test_pipeline(spark):
    import corpus_pipeline
    import sentencepiece

    from skyfix.llm.shared import table

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = {r.doc_id for r in quality_rules.keep(table(spark, SF, "documents")).collect()}
    assert 0 < len(rows) <= len(kept) and set(rows) <= kept
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for r in rows.values():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(r.ids).encode()).hexdigest()
    assert math.isfinite(sum(r.n_tokens for r in rows.values()))
