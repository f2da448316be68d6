"""Edges that all operators share: clashing names, null and repeated ids, ties, repeated rows, long texts, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_extraction, language_id, license_scan, line_dedup, near_dedup, quality_rules, secret_scan
from tessera.llm import sentencepiece_codec as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CLASHING = ("_l", "_l_doc", "_l_later", "doc_0", "l_0", "later_0", "_n_doc", "_q_words", "_q_host", "_q_source", "n_words", "kept", "c0", "source_0", "quality", "block", "key")


def clashing(spark):
    three = "\n".join(f"line {k} of a text with words" for k in range(20))
    rows = [(1, three, "a"), (2, three, "a"), (None, three + "\n" + three, "b"), (2, three, None), (3, None, "b"), (4, " ".join(f"w{k}" for k in range(80)), "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


def test_filters_keep_columns_of_any_name(spark):
    docs = clashing(spark)
    items = spark.createDataFrame([(1, "nothing of the kind stands anywhere")], "item_id bigint, text string")
    whole = docs.count()
    edited = line_dedup.edit_documents(docs)
    assert edited.columns == docs.columns and edited.count() == whole
    assert all(r[c] == c for r in edited.collect() for c in CLASHING)
    for out in (near_dedup.filter_documents(docs), quality_rules.filter_documents(docs), decontamination.filter_documents(docs, items)):
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHING)
    assert quality_rules.judge(docs).columns == [*docs.columns, "quality"]


def test_rows_without_doc_id_stay_as_they_are(spark):
    docs = clashing(spark)
    (loose,) = docs.where("doc_id IS NULL").collect()
    for out in (line_dedup.edit_documents(docs), near_dedup.filter_documents(docs)):
        assert [r["text"] for r in out.where("doc_id IS NULL").collect()] == [loose["text"]]


def test_long_texts(spark):
    rng = random.Random(4)
    spaced = " ".join(f"{rng.randrange(10**6)}" for _ in range(700_000))
    dense = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300_000))
    secrets = "token=abcdef " * 60_000
    docs = spark.createDataFrame([(1, spaced, "a"), (2, spaced + " tail", "a"), (3, dense, "b"), (4, secrets, "c")], "doc_id bigint, text string, source string")
    assert len(spaced) > 4_500_000
    assert {r["doc"]: r["component"] for r in near_dedup.groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["quality"]["n_words"] for r in quality_rules.judge(docs, keep=["doc_id"]).collect()} == {1: 700_000, 2: 700_001, 3: 1, 4: 60_000}
    found = {r["doc_id"]: r["found"] for r in secret_scan.scan(docs)[0].collect()}
    assert [len(found[k]) for k in (1, 2, 3, 4)] == [0, 0, 0, 60_000]
    assert [tuple(s) for s in found[4][-1:]] == [(13 * 59_999, 0, 13 * 59_999 + 12)]
    assert {r["doc_id"]: r["_l"]["n_removed"] for r in line_dedup.dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    pieces = sp.encode(docs.where("doc_id = 3"), MODEL).collect()
    assert [r["round_trip"] for r in pieces] == [True]
    page = "<article>" + "".join(f"<p>{spaced[k : k + 1000]}</p>" for k in range(0, len(spaced), 1000)) + "</article>"
    assert len(html_extraction.extract(page)) > 4_500_000


def test_no_letters_no_language(spark):
    assert language_id.words_of("² ½ Ⅷ 12 _") == []
    assert language_id.words_of("x² ½yⅧz") == ["x", "y", "z"]
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)] + [(90, "² ½ Ⅷ", "en"), (91, None, "en"), (92, "12", None), (90, "² ½ Ⅷ", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 3 != 1)
    out = language_id.predict(docs, model)
    got = {r[0]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert [got[k] for k in (90, 91, 92)] == [("und", 0.0)] * 3
    assert got[0][0] == "en" and got[1][0] == "de"
    assert language_id.predict(docs.where("doc_id < 0"), model).collect() == []


def test_matches_equal_scoring_every_passage():
    """With the bounds over whole batches, the essential words and WAND, against a plain BM25 over every passage."""
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 400}"
    items = [(k, " ".join(word() for _ in range(rng.randint(4, 30))) + ". " + " ".join(word() for _ in range(rng.randint(1, 6)))) for k in range(120)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(80)]
    for k in range(0, 80, 2):
        own = rng.choice(items)[1].split()
        own = [w for w in own if rng.random() < 0.85]
        texts[k] = texts[k] + " " + " ".join(own) + " " + texts[k + 1]
    index = decontamination.Index(items)
    bags = {k: Counter(decontamination.words_of(t)) for k, t in items}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(1 + (len(bags) - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    weight = lambda k, w: idf[w] * bags[k][w] * 2.2 / (bags[k][w] + 1.2 * (0.25 + 0.75 * sum(bags[k].values()) / mean))
    whole = {k: sum(weight(k, w) for w in bags[k]) for k in bags}
    for text, got in zip(texts, index.matches_of(texts)):
        words = decontamination.words_of(text)
        best: dict[int, tuple] = {}
        for at in range(0, max(1, len(words) - index.stride), index.stride):
            passage = words[at : at + 2 * index.stride]
            have = set(passage)
            for k, t in items:
                score = sum(weight(k, w) for w in bags[k] if w in have) / whole[k]
                if score >= decontamination.THRESHOLD - 1e-9:
                    q, a, both = decontamination.overlaps(passage, *decontamination.question_and_answer(t))
                    if (q >= 0.5 and a >= 0.5) or both >= 0.6:
                        best[k] = max(best.get(k, (-1.0,)), (round(score, 6), q, a, -at))
        assert [(k, s, q, a, at) for k, s, q, a, at in got] == [(k, s, q, a, -at) for k, (s, q, a, at) in sorted(best.items())]


def test_prior_at_both_ends(spark):
    """Hosts that do not vary get the greatest strength, hosts of rates 0 and 1 the least; both by the closed form."""
    good, bad = " ".join(f"w{k}" for k in range(60)), "short"
    even = [(h * 100 + k, bad if k < 2 else good, f"h{h}") for h in range(5) for k in range(10)]
    split = [(h * 100 + k, bad if h < 2 else good, f"h{h}") for h in range(5) for k in range(10)]
    for rows, strength in ((even, quality_rules.PRIOR_MAX), (split, quality_rules.PRIOR_MIN)):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        got = {r["host"]: r["rates"][0] for r in quality_rules.host_verdicts(quality_rules.measure(docs), "c2").collect()}
        m = sum(t == bad for _, t, _ in rows) / len(rows)
        for host in got:
            f = sum(t == bad for _, t, s in rows if s == host)
            assert got[host] == pytest.approx((f + m * strength) / (10 + strength))


def test_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>One &amp; two</p><ul><li><a href='x'>Only a link</a></li></ul></article>")] * 2 + [(2, None, None)], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extraction.main_text(pages).collect())
    assert got == [(1, "One & two\nOnly a link", 21)] * 2 + [(2, "", 0)]
    assert html_extraction.main_text(pages.where("page_id > 9")).collect() == []
    docs = spark.createDataFrame([(1, "MIT License", "a/LICENSE"), (1, "MIT License", "a/LICENSE"), (2, "x", "a/b/c.py")], "doc_id bigint, text string, path string")
    assert sp.encode(docs.where("doc_id > 9"), MODEL).collect() == []
    found, _ = secret_scan.scan(spark.createDataFrame([(1, "password: abcdefg")] * 3, "doc_id bigint, text string"))
    assert [r["spans"] for r in found.select(*secret_scan.digest()).collect()] == ["assign:0:17"] * 3
    assert found.select(*secret_scan.digest()).first()["base_sha256"] == hashlib.sha256(b"assign:0:17").hexdigest()
    assert license_scan is not None


@pytest.mark.parametrize("seed", range(3))
def test_block_rules_against_plain_reading(seed):
    """Both passes, against a reading that looks at every block's neighbours one by one."""
    rng = random.Random(seed)
    for _ in range(300):
        labels = [rng.choice(["good", "bad", "near", "short", "heading"]) for _ in range(rng.randint(0, 9))]
        got = html_extraction.second_pass(labels)
        for k, label in enumerate(labels):
            up = next(((labels[j], k - j) for j in range(k - 1, -1, -1) if labels[j] in ("good", "bad")), ("", 99))
            down = next(((labels[j], j - k) for j in range(k + 1, len(labels)) if labels[j] in ("good", "bad")), ("", 99))
            if label in ("good", "bad"):
                want = label == "good"
            elif label == "near":
                want = "good" in (up[0], down[0]) or up[0] == down[0] == ""
            elif label == "heading" and down[0]:
                want = down[0] == "good" and (up[1] >= down[1] or up[0] == "good" or down[1] <= html_extraction.HEADING_REACH)
            else:
                want = (up[0] == down[0] == "good") if up[1] == down[1] else min((up[1], up[0]), (down[1], down[0]))[1] == "good"
            assert got[k] == want, (labels, k)
    text = lambda n, w: " ".join([w] * n)
    first = html_extraction.first_pass
    assert first(text(60, "the"), 0, 0, "p") == "good" and first(text(60, "zzzz"), 0, 0, "p") == "near"
    assert first(text(60, "zzzz"), 0, 0, "p", known=False) == "good" and first(text(5, "the"), 0, 0, "p") == "short"
    assert first(text(5, "the"), 0, 0, "h2") == "heading" and first(text(60, "the"), 200, 0, "p") == "bad"
    assert first(text(60, "the"), 0, 2, "p") == first(text(60, "the"), 0, 3, "p") == "bad" and first("a link", 6, 1, "li") == "near"
