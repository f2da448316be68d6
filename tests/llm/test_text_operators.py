"""Operators on single texts and on document tables, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_extraction, language_id, license_scan, line_dedup, near_dedup, quality_rules, secret_scan, substring_dedup
from tessera.llm import sentencepiece_codec as sp
from tessera.llm.components import components

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string"


def corpus(seed: int = 3, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [" ".join(words(12)) for _ in range(6)]
    texts: list[str | None] = []
    for k in range(n):
        lines = [" ".join(words(rng.randint(1, 15))) for _ in range(rng.randint(1, 9))]
        if k % 4 == 0:
            lines[1:1] = shared[:3]
        if k % 7 == 0 and texts and texts[-1]:
            base = texts[-1].split(" ")
            base[len(base) // 2] = "Changed"
            lines = [" ".join(base)]
        if k % 9 == 0 and texts:
            texts.append(texts[rng.randrange(len(texts))])
            continue
        texts.append("\n".join(lines))
    return [*texts, None, "", "   ", "one", "one two", "x" * 300, "é" * 40, "a\n\n\n\n\n\na"]


def frame(spark, texts):
    rows = [Row(doc_id=k, text=t, lang="en", source=None if k % 11 == 0 else f"s{k % 3}", n_chars=len(t or ""), kept=False, n_words="x") for k, t in enumerate(texts)]
    rows += [rows[5], Row(doc_id=None, text="no id at all", lang=None, source="s0", n_chars=3, kept=None, n_words=None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_spans(texts: dict[int, bytes]) -> dict[int, tuple]:
    seen: dict[bytes, int] = {}
    out = {}
    for doc in sorted(texts):
        body = texts[doc]
        covered = bytearray(len(body))
        own = [body[i : i + 50] for i in range(len(body) - 49)]
        for i, s in enumerate(own):
            if s in seen:
                covered[i : i + 50] = b"\1" * 50
        for s in own:
            seen.setdefault(s, doc)
        kept = bytes(b for b, c in zip(body, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[doc] = (kept, len(body), sum(covered), spans)
    return out


def test_substrings_equal_brute_force(spark):
    texts = corpus()
    docs = frame(spark, texts)
    got = {r["doc"]: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)[1:] for r in substring_dedup.remove_repeats(docs).collect() if r["doc"] is not None}
    want = brute_spans({k: (t or "").encode() for k, t in enumerate(texts)})
    assert got == want
    assert substring_dedup.remove_repeats(empty(spark)).collect() == []
    loose = [r for r in substring_dedup.remove_repeats(docs).collect() if r["doc"] is None]
    assert [(bytes(r["kept"]), r["n_removed"]) for r in loose] == [(b"no id at all", 0)]


def test_lines_equal_brute_force(spark):
    texts = corpus()
    docs = frame(spark, texts)
    first: dict[tuple, tuple] = {}
    for doc, text in enumerate(texts):
        lines = (text or "").split("\n")
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (doc, i))
    got = {r["doc_id"]: r["text"] for r in line_dedup.edit_documents(docs).collect()}
    for doc, text in enumerate(texts):
        if text is None:
            assert got[doc] is None
            continue
        lines = text.split("\n")
        gone = {i + k for i in range(len(lines) - 2) for k in range(3) if "".join(lines[i : i + 3]).strip() and first[tuple(lines[i : i + 3])] != (doc, i)}
        assert got[doc] == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert line_dedup.edit_documents(docs).columns == docs.columns
    assert line_dedup.edit_documents(empty(spark)).collect() == []


def brute_groups(texts, width: int, percent: int) -> dict[int, int]:
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in range(len(texts))}


@pytest.mark.parametrize(("width", "block"), [(4, 1 << 20), (5, 1 << 20), (4, 3000)])
def test_near_groups_equal_brute_force(spark, monkeypatch, width, block):
    """With small blocks, too, so that buckets of several blocks take part."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
    rng = random.Random(7)
    texts = corpus()
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    got = {r["doc"]: r["component"] for r in near_dedup.groups(frame(spark, texts), width, 80).collect() if r["doc"] is not None}
    assert got == brute_groups(texts, width, 80)


def test_near_filter_and_edges(spark):
    texts = corpus()
    docs = frame(spark, texts)
    kept = near_dedup.filter_documents(docs)
    want = brute_groups(texts, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, c in want.items() if k == c} | {None}
    assert kept.columns == docs.columns
    assert near_dedup.groups(empty(spark)).collect() == []


def test_estimate_corrects_collisions():
    import numpy as np

    assert 1e-4 < near_dedup.collision_rate(np.array([500]), np.array([500]))[0] < 1e-3
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.concatenate((shared, rng.integers(0, 2**63, 100).astype(np.uint64))) for _ in range(2))
    agree = (near_dedup.registers(a) == near_dedup.registers(b)).mean()
    assert abs(agree - 0.8) < 0.12


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (3, 5), *[(100 + k, 101 + k) for k in range(30)]], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, **{100 + k: 100 for k in range(31)}}
    assert components(edges.where("a < 0")).collect() == []


def test_quality(spark):
    texts = [*corpus(), "w " * 60, " ".join(f"w{k}" for k in range(60))]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["quality"] for r in quality_rules.judge(docs).collect()}
    for doc, text in enumerate(texts):
        words = [w for w in (text or "").replace("\n", " ").split(" ") if w]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) for k in range(3) if grams.count(g) > 1}
        row = got[doc]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.filter_documents(docs).columns == docs.columns
    assert {r["doc_id"] for r in quality_rules.filter_documents(docs).collect()} == {d for d, r in got.items() if r["kept"]}
    assert quality_rules.judge(empty(spark)).collect() == []


def test_hosts_are_shrunk(spark):
    rows = [(k, "bad " * 3, "junk") for k in range(40)] + [(100 + k, " ".join(f"w{k}x{j}" for j in range(60)), "good" if k < 40 else "junk") for k in range(42)]
    docs = spark.createDataFrame([*rows, (900, "short", "tiny")], "doc_id bigint, text string, source string")
    verdict = {r["host"]: r["host_rejected"] for r in quality_rules.host_verdicts(quality_rules.measure(docs), "c2").collect()}
    assert verdict == {"junk": True, "good": False, "tiny": False}


def test_secrets(spark):
    texts = [
        None, "", 'é password = "abcdef1"', "Secret=token: abcdefg", "api_key:12345", "AKIA" + "A1" * 8 + " " + "a1" * 12, "x" + "0" * 23,
        "TOKEN=" + "ab12" * 9, "-----BEGIN RSA PRIVATE KEY-----", "token=abcdef token=ghijkl",
    ]
    docs = frame(spark, texts)
    found, ledger = secret_scan.scan(docs)
    got = {r["doc_id"]: r for r in found.select("doc_id", *secret_scan.digest()).collect()}
    assert [got[k]["spans"] for k in range(len(texts))] == [
        "", "", "assign:2:21", "", "", "access:0:20,hex:21:45", "", "assign:0:42,hex:6:42", "pem:0:31", "assign:0:12,assign:13:25",
    ]
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.scan_unseen(docs.select("doc_id", "text"), ledger).count() == 0
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "passwd=zzzzzz")], "doc_id bigint, text string"))
    assert secret_scan.scan_unseen(more, ledger).count() == 1
    assert secret_scan.scan_unseen(docs.select("doc_id", "text"), ledger, rule_version="next").count() == ledger.count()
    assert secret_scan.scan(empty(spark))[0].collect() == []


def test_leaks(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(6))) for k in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[4][1].split(" ")
    edited[3] = "other"
    texts = [noise(300), noise(200) + " " + items[2][1].upper() + " " + noise(90), items[3][1], noise(50) + " " + " ".join(edited), None, "", " ".join(items[6][1].split(" ")[:6]), noise(5000) + " " + items[9][1]]
    docs = frame(spark, texts)
    table = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = {(r["doc"], r["item_id"]) for r in decontamination.contaminated(docs, table).collect()}
    assert got == {(1, 2), (2, 3), (3, 4), (7, 9)}
    clean = decontamination.filter_documents(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {0, 4, 5, 6, None}
    assert decontamination.contaminated(docs, table.where("item_id < 0")).collect() == []
    shards = list(decontamination.indexes(table, max_bytes=800))
    assert len(shards) > 1
    (one,) = decontamination.indexes(table)
    plain = lambda held: sorted((d, *m) for d, t in enumerate(texts) for s in held for m in s.matches(t))
    assert plain(shards) == plain([one])
    assert {(m[0], m[1]) for m in plain(shards)} == got


def test_wand_equals_scoring_everything():
    rng = random.Random(5)
    items = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(rng.randint(3, 30)))) for k in range(300)]
    index = decontamination.Index(items)
    for _ in range(200):
        base = rng.choice(items)[1].split()
        passage = {index.terms[w] for w in base + rng.choice(items)[1].split() if rng.random() < 0.8}
        scores: dict[int, float] = {}
        for t in passage:
            for k, w in zip(index.items[t], index.weights[t]):
                scores[k] = scores.get(k, 0.0) + w
        want = {k for k, s in scores.items() if s >= 0.5 - 1e-9}
        assert {k for k, _ in index.search(sorted(passage))} == want


def test_pieces_round_trip_and_best_score(spark):
    import sentencepiece

    codec = sp.Codec(MODEL)
    texts = ["Hello  world\nfoo\tbar é 漢字 x ", "", " ", "   a", "日本語😀😀 ok", "\n\n a\n", "rrrr %%%% &&&", *[t for t in corpus() if t]]
    for text in texts:
        assert codec.decode(codec.encode(text)) == text
    bpe = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = {bpe.id_to_piece(i): i for i in range(bpe.get_piece_size()) if not (bpe.is_byte(i) or bpe.is_control(i) or bpe.is_unknown(i))}
    for text in texts[:20]:
        whole = ("▁" + text.replace(" ", "▁")) if text else ""
        best = [0.0] + [float("-inf")] * len(whole)
        for e in range(1, len(whole) + 1):
            for s in range(max(0, e - 16), e):
                if whole[s:e] in pieces:
                    best[e] = max(best[e], best[s] + codec.scores[pieces[whole[s:e]]])
            if whole[e - 1] not in pieces:
                best[e] = max(best[e], best[e - 1] + codec.unknown_score)
        ids = codec.encode(text)
        unknown = sum(1 for c in whole if c not in pieces)
        total = sum(codec.scores[i] for i in ids if not codec.is_byte[i]) + unknown * codec.unknown_score
        assert total == pytest.approx(best[-1])
    docs = frame(spark, corpus())
    rows = sp.encode(docs, MODEL).collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == docs.count()
    assert all(r["ids"] == codec.encode(t or "") for r, t in zip(sorted((r for r in rows if r["doc"] is not None), key=lambda r: r["doc"])[:5], corpus()[:5]))
    back = sp.decode(sp.encode(docs, MODEL), MODEL)
    assert {(r["doc"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert sp.encode(empty(spark), MODEL).collect() == []


def test_languages(spark):
    rng = random.Random(2)
    sounds = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    rows = [(k * 3 + j, " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(30)), lang) for k in range(60) for j, (lang, s) in enumerate(sounds.items())]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 456 !", "bb"), (902, "vwxyz", None)], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), F.col("doc_id"))
    got = {r["doc"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang in rows)
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.predict(docs, language_id.fit(docs.where("doc_id < 0"), F.col("doc_id"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    total = sum(2.718281828459045 ** model.score([a])[0, 0] for a in ["a", "b", "c", "d", "e"])
    assert 0 < total <= 1.0


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<header><h2>Site</h2></header><article><h1>Head &amp; more</h1><p>First   <b>bold</b>
line<br>next<p>Second &#233;&nbsp;x<script>var a="</p>";</script><div class="comments"><p>Nice!</p></div></article><aside>Side</aside><form><input>Go</form><footer>&copy; me</footer>"""
    assert html_extraction.extract(page) == "Head & more\nFirst bold line next\nSecond é x"
    para = "The main text of the page is in this block and it has many of the words that are to be found in it, so that it is long enough to be good at once, and more of it is here."
    plain = f"<div><a href=x>one</a> <a href=y>two</a></div><div>{para} {para}</div><div>Short one</div><div>{para} {para}</div><div><a href=z>three</a></div><div>tail</div>"
    assert html_extraction.extract(plain) == f"{para} {para}\nShort one\n{para} {para}"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut <b")], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.main_text(pages).collect()}
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[1][1] == len(got[1][0])


def test_licenses(spark):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code\n\nmore"), (3, "a/b/y.py", "words of all kinds\nLicensed under the Apache License, Version 2.0."), (4, "z.py", None), (5, None, ""), (6, "a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), (7, "LICENSEE/q", "nothing")],
        "file bigint, path string, text string",
    )
    got = {r["file"]: (r["license"], r["license_from"]) for r in license_scan.scan(files).collect()}
    assert got == {1: ("MIT", "own"), 2: ("GPL-3.0", "dir:a/b"), 3: ("Apache-2.0", "own"), 4: (None, "none"), 5: (None, "none"), 6: ("GPL-3.0", "own"), 7: (None, "none")}
    assert license_scan.scan(files.where("file < 0")).collect() == []


def test_license_notices_inside_lines_and_paragraphs():
    """Against all runs of words of a template's length, each scored by itself."""
    templates = license_scan.Templates()
    words_of = license_scan._WORD.findall
    lengths = {len(words_of(t.lower())) for _, t in license_scan.TEMPLATES}

    def alone(run: list[str]) -> tuple[float, str]:
        found = [(0.0, "")]
        norm = sum((run.count(w) * templates.idf.get(w, templates.unknown)) ** 2 for w in set(run)) ** 0.5
        for name, body in license_scan.TEMPLATES:
            own = words_of(body.lower())
            both = set(run) & set(own)
            if len(both) >= min(3, len(set(own))):
                size = sum((own.count(w) * templates.idf[w]) ** 2 for w in set(own)) ** 0.5
                found.append((sum(min(run.count(w), own.count(w)) * own.count(w) * templates.idf[w] ** 2 for w in both) / norm / size, name))
        return min(found, key=lambda f: (-f[0], f[1]))

    def brute(text: str) -> tuple[float, str]:
        words = words_of(text.lower())
        runs = [words[a : a + n] for n in {min(n, len(words)) for n in lengths} for a in range(len(words) - n + 1)]
        return min(((-s, name) for s, name in (alone(r) for r in runs)), default=(0.0, ""))

    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    header = dict(license_scan.TEMPLATES[::-1])["Apache-2.0"].split()
    wrapped = "\n".join("# " + " ".join(header[k : k + 8]) for k in range(0, len(header), 8))
    texts = {
        "Copyright 2024 Example Software Foundation Inc. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Posted by Jane Doe on Monday. Released under the MIT License. Comments welcome.": "MIT",
        "Copyright (c) 2021 Jane Doe and the Example contributors. All rights reserved.": "proprietary",
        f"{noise(30)} released under the MIT license {noise(30)}": "MIT",
        wrapped + "\n" + "\n".join(noise(6) for _ in range(26)): "Apache-2.0",
        f"{noise(40)} mit {noise(40)} limit": None,
        f"{noise(20)} mit mit der {noise(20)}. Mit. {noise(20)}": None,
        f"{noise(20)} gave up all rights to the house {noise(20)}": None,
        "license " * 60 + noise(9): None,
    }
    for _, t in license_scan.TEMPLATES:
        body = t.split()
        body[rng.randrange(len(body))] = "changed"
        texts[f"{noise(rng.randint(0, 40))} {' '.join(body)} {noise(rng.randint(1, 40))} all rights"] = ""
    for text, want in texts.items():
        name, score = templates.of_text(text)
        least, nearest = brute(text)
        assert score >= (round(-least, 6) if round(-least, 6) >= license_scan.THRESHOLD else 0) and (want == "" or name == want), text
        if round(-least, 6) == score and score >= license_scan.THRESHOLD:
            assert name == nearest


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article style="overflow:hidden"><p>One</p></article>', "One"),
        ('<article data-hidden="false" title="hidden class=ad gems"><p>One</p></article>', "One"),
        ("<article><p>One</p><p hidden>Two</p><p HIDDEN=''>Three</p><p aria-hidden=true>Four</p></article>", "One"),
        ('<article><p>One</p><svg viewBox="0 0 1 1"/><p>Two</p><math /><p>Three</p></article>', "One\nTwo\nThree"),
        ("<article><p>One</p><svg><path d='M0'/><text>no</text></svg><p>Two</p><svg-icon name='x'></svg-icon><p>Three</p></article>", "One\nTwo\nThree"),
        ('<article><h2 id="side-effects">One</h2><section id="related-work"><p>Two</p></section><section id="reader-comments-policy"><p>Three</p></section></article>', "One\nTwo\nThree"),
        ('<article><p>One</p><div class="x related-work">Two</div><div class="cookie-notice">no</div><div class="x related-posts">no</div><ul class="comment-list"><li>no</ul><aside>no</aside><div role="search">no</div></article>', "One\nTwo"),
        ('<body class="single comments-open"><article class="post comments-open"><p>One</p></article><div id="comments"><article class="comment-body"><p>no</p></article></div>', "One"),
        ('<main><p>One</p></main><article id="comment-5"><p>no</p></article><div id="site-footer-links">no</div>', "One"),
    ],
)
def test_ordinary_markup_keeps_the_article(page, want):
    assert html_extraction.extract(page) == want


def test_unmarked_pages_of_other_languages_code_and_lists():
    menu, foot = '<div><a href="/">uno</a> <a href="/2">due</a></div>', '<div><a href="/p">privacy</a></div>'
    body = lambda *blocks: menu + "".join(f"<div>{b}</div>" for b in blocks) + foot
    italian = "Quando arrivò al paese, ogni finestra era già chiusa; nessuno sembrava aspettare qualcuno, eppure dietro le persiane molti occhi guardavano quello straniero camminare lentamente verso la piazza deserta, senza bagagli."
    russian = "Когда он приехал в деревню, все окна уже были закрыты; казалось, никто никого не ждал, но из-за ставней многие глаза следили за тем, как незнакомец медленно идёт к пустой площади без всякого багажа и без спутников."
    chinese = "他到达村庄的时候，所有的窗户都已经关上了。似乎没有人在等待任何人，然而百叶窗后面有许多眼睛注视着这个陌生人慢慢走向空荡荡的广场，既没有行李，也没有同伴。夜色渐渐降临，远处传来几声狗叫，他停下脚步，抬头看着钟楼。"
    for text in (italian, russian, chinese):
        assert html_extraction.extract(body(text, text)) == f"{text}\n{text}"
    para = "The main text of the page is in this block and it has many of the words that are to be found in it, so that it is long enough to be good at once, and more of it is here."
    english = f"{para} {para}"
    code = "def total(values): return functools.reduce(operator.add, map(float, values), 0.0); print(total([1, 2, 3]))"
    names = "Alvarez, Bennett, Castillo, Dimitrov, Eriksen, Fitzgerald, Gutierrez, Hernandez, Ivanova, Johansson"
    assert html_extraction.extract(body(english, code, english, names)) == f"{english}\n{code}\n{english}\n{names}"
    assert html_extraction.extract(body(english, 'Short, see <a href="x">here</a> for what follows', english)) == f"{english}\nShort, see here for what follows\n{english}"
    assert html_extraction.extract(menu + f"<div>{names}</div>" + foot + f"<div>{english}</div>" + foot) == english


def test_leaks_of_items_that_share_an_id_or_have_none(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    items = [(k // 2, text(20) + ". " + text(6)) for k in range(20)] + [(None, text(20) + ". " + text(6)) for _ in range(2)]
    table = spark.createDataFrame([*items, items[3], items[20], (5, None)], "item_id bigint, text string")
    texts = [text(60) + " " + t + " " + text(60) for _, t in items] + [text(200)]
    docs = frame(spark, texts).where(F.col("doc_id") != 5)
    want = sorted(((k, i) for k, (i, _) in enumerate(items) if k != 5), key=str)
    assert sorted(((r["doc"], r["item_id"]) for r in decontamination.contaminated(docs, table).collect()), key=str) == want
    assert [r["doc_id"] for r in decontamination.filter_documents(docs, table).collect()] == [len(items)]
    shards = list(decontamination.indexes(table, max_bytes=800))
    assert len(shards) > 1
    assert sorted(((d, m[0]) for d, t in enumerate(texts) if d != 5 for s in shards for m in s.matches(t)), key=str) == want
