"""Small cases and brute force for the operators: nulls, empty tables, repeats, ties, long texts, clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from freshet.llm import decontamination, html_text, license_scan, mixing, near_dedup, quality, token_output, topk_search, url_filter
from freshet.llm.queries import QUERIES, SQL, TOKENIZER
from tests.compare import difference, duck, spark_rows
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, place string, component string, size int"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def documents(spark, rows):
    """Rows (doc_id, text, source) with the columns of documents and some whose names clash."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", 3) for i, t, s in rows], DOCS)


ODD = [(None, "no id", "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "one", "b"), (4, "one", "b"), (5, "word " * 30_000, "c"), (6, "é 日本 \x00 x", "c")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    dtypes, rows = spark_rows(spark, QUERIES[name], SF)
    assert difference(dtypes, rows, con, SQL[name]) is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names


# 1: token files


def test_tokens_round_trip(spark):
    rows = [*ODD, (9, "a <|endoftext|> b", "a"), (10, "  two  spaces \n x<|endoftext|>y <|endoftext|>", "a"), (11, " ", "a"), (12, " lead  日 本 é", "a"), (8, "the cat's  hat\n\n and\tmore", "a")]
    files = token_output.write_tokens(documents(spark, rows), TOKENIZER, file_documents=3)
    found = token_output.read_summary(files).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, token_output.END_ID]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(8,), (5,), (77,)], "doc_id long")
    got = token_output.read_documents(spark, files, asked).orderBy("doc_id", "nth").collect()
    assert {r.doc_id for r in got} == {5, 8}
    assert [x for r in got if r.doc_id == 8 for x in r.ids] == [*plain.encode(rows[-1][1], add_special_tokens=False).ids, 2]


def test_token_file_is_seekable_and_checked(spark):
    files = token_output.write_tokens(documents(spark, [(1, "a b", "x"), (2, "c d", "x")]), TOKENIZER).collect()
    system, place = fs.FileSystem.from_uri(files[0].path)
    raw = bytearray(system.open_input_file(place).read())
    assert struct.unpack("<I", raw[-4:]) == (token_output.SEEKABLE_MAGIC,)
    raw[6] ^= 1
    import pyarrow as pa

    reader = token_output.FrameReader(pa.BufferReader(bytes(raw)))
    with pytest.raises(Exception):  # noqa: B017  whichever of the two checksums sees it first
        list(reader.ids(0))
    assert len(list(reader.ids(1))) == 1


def test_no_documents_no_tokens(spark):
    assert token_output.read_summary(token_output.write_tokens(documents(spark, []), TOKENIZER)).count() == 0


def test_pieces_encode_like_whole_texts():
    encoder, plain, rng = token_output.Encoder(TOKENIZER), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "1", "'s", "!", "***", "<|endoftext|>", "日", "\x85", " ", "😀", "ÿ", "\r\n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == want


def test_a_full_memory_keeps_the_pieces_of_the_last_texts(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 50)
    encoder, learnt = token_output.Encoder(TOKENIZER), []
    learn = encoder._learn_together
    monkeypatch.setattr(encoder, "_learn_together", lambda pieces: learnt.append(len(pieces)) or learn(pieces))
    before, last = [" ".join(f"{c}{k}" for k in range(60)) for c in ("a", "b")]
    encoder.encode([before])
    first = encoder.encode([last])
    assert encoder.encode([last]) == first == [encoder._ids(last).tobytes()]
    assert learnt == [59, 59] and len(encoder.known) == 59


def test_pieces_that_came_again_outlast_those_that_came_once(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 160)
    encoder, learnt = token_output.Encoder(TOKENIZER), []
    learn = encoder._learn_together
    monkeypatch.setattr(encoder, "_learn_together", lambda pieces: learnt.append(len(pieces)) or learn(pieces))
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    for c in "aabcdef":
        encoder.encode([text(c)])
    assert encoder.encode([text("a"), text("a")]) == [encoder._ids(text("a")).tobytes()] * 2
    assert learnt == [59] * 6
    assert len(encoder.known) + len(encoder.once) + len(encoder.older) <= 160


# 2: top-k


def brute(vectors, k):
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in rows:
        if q % 3 == 0:
            best = sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [64, 100_000])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 5).round(1)]) for i in range(200)]
    vectors += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (306, [float("inf")] * 5), (None, [1.0] * 5), (309, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, rank int, block int").repartition(3)
    found = topk_search.top_k(df, F.col("vec_id") % 3 == 0, k=7)
    assert {tuple(r) for r in found.collect()} == brute(vectors, 7)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, (130, 9))
    block = topk_search.Block.of(np.arange(130), values - 500)
    query = rng.integers(-700, 700, 9)
    slices, constant = block.scores(query, block.stacked())
    bits = np.unpackbits(np.ascontiguousarray(slices).view(np.uint8), axis=1, bitorder="little")[:, :130]
    sums = (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(axis=0) + constant
    assert (sums == (values - 500) @ query).all()


# 3: decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_of(text, items):
    words, hit, found = plain_words(text), set(), set()
    for i, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(i))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_decontamination_finds_every_window(spark):
    rng = random.Random(4)
    vocabulary = "the of and a in ab cd ef gh Zürich x1".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([14, 25, 10]))) for i in range(8)] + [(20, "rare"), (21, ""), (22, None), (9, "two words"), (10, text(12))]
    rows = list(ODD)
    for i in range(40):
        _, t = rng.choice(items[:8])
        w = t.split()
        cut = rng.randint(0, 5)
        rows.append((100 + i, f"{text(rng.randint(0, 30))}. {' '.join(w[cut:])}, {text(rng.randint(0, 9))}".upper(), "a"))
    rows += [(200, "a rare thing; rare!", "a"), (201, "two words two words", "a"), (202, "two, wor ds", "a")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc string")
    found = decontamination.digest(decontamination.decontaminate(documents(spark, rows), bench)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in found) == sorted((str(i), *hits_of(t, items)) for i, t, _ in rows)
    assert decontamination.decontaminate(documents(spark, []), bench).count() == 0
    clean = decontamination.decontaminate(documents(spark, ODD), bench.limit(0)).where("contaminated").count()
    assert clean == 0


def test_proximity_allows_missing_words(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("five", "else"), "a"), (2, item.replace("five", "else").replace("six", "more"), "a"), (3, item, "a")]
    found = {r.doc_id: r.contaminated for r in decontamination.decontaminate(documents(spark, rows), bench, slack=1).collect()}
    assert found == {1: True, 2: False, 3: True}


# 4: licences


def test_license_rules(spark):
    mit = " ".join(license_scan.SENTENCES["mit-grant"][0].split())
    rows = [
        *ODD,
        (10, "Prose here.\nReleased under the MIT License.\nMore prose", "a"),
        (11, f"{mit}\n\n{license_scan.SENTENCES['mit-notice'][0]}.", "a"),
        (12, "licensed UNDER cc by-nc 4.0! Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0 or not.", "a"),
        (13, license_scan.SENTENCES["bsd-source"][0], "a"),
    ]
    found = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, rows)).collect() if r.doc_id and r.doc_id > 9}
    assert {i: r.licenses for i, r in found.items()} == {10: "MIT", 11: "MIT", 12: "CC-BY-NC-4.0,CC-BY-4.0", 13: ""}
    assert (found[13].n_known, found[13].n_unmatched, found[11].n_unmatched) == (1, 1, 0)
    assert license_scan.scan_licenses(documents(spark, ODD)).count() == len(ODD)


def test_a_version_number_alone_states_no_license(spark):
    notice = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed with this file, look around."
    rows = [(10, "2.0", "a"), (11, "Release notes\n2.0\nMozilla", "a"), (12, notice, "a"), (13, "/* " + notice.replace("License, v", "License,\n * v") + " */", "a")]
    found = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    assert {i: r.licenses for i, r in found.items()} == {10: "", 11: "", 12: "MPL-2.0", 13: "MPL-2.0"}
    assert found[12].sentence_ids == "mpl2-line,version-2-0" and found[12].n_unmatched == 0
    with pytest.raises(ValueError, match="2 sentences"):
        license_scan.table_of({"x": ["One. Two"]})


def test_license_sentences_wrapped_over_lines(spark):
    import textwrap

    def wrapped(*names, mark="", ends="."):
        texts = [textwrap.fill(license_scan.SENTENCES[n][0] + ("" if license_scan.SENTENCES[n][0][-1] == ":" else ends), 72) for n in names]
        return "\n\n".join("\n".join(mark + line for line in t.split("\n")) for t in texts)

    bsd = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")
    rows = [
        (10, "Copyright\n\n" + wrapped("mit-grant", "mit-notice"), "a"),
        (11, wrapped(*bsd, mark=" * ").replace("\n\n", "\n *\n").replace(" * Redistributions", " * 1. Redistributions"), "a"),
        (12, wrapped(*bsd[:3]).replace("\n", "\r\n"), "a"),
        (13, wrapped("gpl3-free", "gpl-hope", mark="# "), "a"),
        (14, wrapped("gpl2-free", mark="// "), "a"),
        (15, "Prose about it\n" + wrapped("mit-grant") + "\nmore prose", "a"),
        (16, "Redistribution and use in source and binary forms,\n\nwith or without modification, are permitted provided that the following conditions are met:", "a"),
        (17, "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0", "a"),
    ]
    found = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    expected = {10: "MIT", 11: "BSD-3-Clause", 12: "BSD-2-Clause", 13: "GPL-3.0-or-later", 14: "GPL-2.0-or-later", 15: "", 16: "", 17: ""}
    assert {i: r.licenses for i, r in found.items()} == expected
    assert [found[i].sentence_ids for i in (15, 16, 17)] == ["mit-grant", "", "apache2-copy"]


def test_time_of_long_pages_grows_with_their_length():
    import time

    def taken(html):
        best = 1e9
        for _ in range(3):
            start = time.process_time()
            html_text.main_text(html)
            best = min(best, time.process_time() - start)
        return best

    for page in ("<p>one short block".__mul__, "<span>a</b>".__mul__, "<div><a>x</i></p>".__mul__):
        assert taken(page(16_000)) < 10 * taken(page(4_000)) + 0.05


# 5: pages

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><p>{run}</p></header><nav><a href=x>one</a></nav>
<div id="cookie-notice">{run}</div><article><header><h1>Title &amp; more</h1></header><p><b>Short one.<br><p>{run}
 and   more<script>var x = "</p>";</script></p><ul><li>First</li><li>Second</ul></article><aside><p>{run}</p></aside>
<form><label>{run}</label></form><section class="comments"><p>{run}</p></section><footer>&copy; {run}</footer>"""
RUN = "It was a day in the life of the town and the people who were there had come from all over the land to see what it was. " * 2


def test_main_text_of_pages(spark):
    plain = f"<div class=content><h2>Head</h2><p>{RUN}</p><p>Short.</p><p>{RUN}</p></div><div><a href=x>{RUN}</a></div><p>Other</p>"
    rows = [(1, "u", PAGE.format(run=RUN.strip())), (2, None, None), (3, "u", ""), (None, "v", plain), (1, "u", "<nav>x</nav>"), (4, "w", "<p>" * 3000 + RUN)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract_text(df).collect()
    texts = sorted((str(r.page_id), r.text) for r in found)
    run = RUN.strip()
    assert texts == sorted(
        [("1", f"Title & more\nShort one.\n{run} and more\nFirst\nSecond"), ("2", ""), ("3", ""), ("None", f"Head\n{run}\nShort.\n{run}"), ("1", ""), ("4", run)]
    )
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["layout has-sidebar", "post with-comments", "no-ads", "sidebar"])
def test_article_in_a_wrapper_named_by_class(name):
    run = RUN.strip()
    page = f"<body><div class='{name}'><article><p>{run}</p></article></div><div class='comments-section'><p>{run}</p></div>"
    assert html_text.main_text(page) == run
    inside = f"<main><p>{run}</p><div class=comments><article><p>{run}</p></article></div></main>"
    assert html_text.main_text(inside) == run
    assert html_text.main_text(f"<nav><article><p>{run}</p></article></nav><div class='ad'><p>{run}</p></div>") == ""


def test_head_without_its_end_tag():
    run = RUN.strip()
    for begin in ("<body>", "", "<div>", "<noscript><img src=x></noscript><body>"):
        page = f"<html><head><meta charset=utf-8><title>T</title><script>var x = 1;</script>\n{begin}<p>{run}</p>"
        assert html_text.main_text(page) == run
    assert html_text.main_text(f"<head><title>T</title>{run}") == run


def test_every_article_of_the_table(spark):
    import html

    rows = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    found = {r.page_id: r.text for r in QUERIES["op5_html_text"](spark, SF).collect()}
    for page_id, page in rows:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[page_id] == "\n".join(b for b in blocks if b)


# 7: quality


def test_quality_learns_and_keeps_folds_apart(spark):
    tables = SF.replace("sf0.001", "sf0.01")
    found = {r.doc_id: r for r in QUERIES["op7_quality"](spark, tables).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{tables}/labels.parquet' where quality is not null").fetchall()
    held = [(found[i].predicted, q) for i, q in labels if found[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(documents(spark, ODD), labels, F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = quality.classify(documents(spark, ODD), labels.limit(0), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(documents(spark, []), labels, F.lit(False)).count() == 0


# 8: mixing


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice("aaaaab") if i % 50 else None) for i in range(3000)]
    got = mixing.mix(documents(spark, [*rows, *ODD[:6]])).collect()
    assert len(got) == len(rows) + 6
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert target <= 3 * size and abs(sum(taken) - target) <= max(60, 0.001 * target)
    assert sum(t for _, t in by) == pytest.approx(min(sum(s for s, _ in by), 3 * sum(s for s, _ in by)))
    again = mixing.mix(documents(spark, [*rows, *ODD[:6]]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mix_ends_among_rows_of_one_id(spark):
    u = (int(hashlib.md5(b"5").hexdigest()[:13], 16) + 0.5) / 2**52
    rows = [(i, "w w w w", "a") for i in range(10, 610)] + [(5, "w w w w", "a")] * 300
    got = mixing.mix(documents(spark, rows).repartition(4), total_share=u * 2 / 3 + 1 / 6, carried=("doc_id", "text")).collect()
    assert len(got) == 900 and all(r.carried.doc_id == r.doc_id and r.carried.text == "w w w w" for r in got)
    assert abs(sum(r.taken for r in got) - got[0].target) <= 2
    assert {r.copies for r in got if r.doc_id == 5} == {0, 1}


def test_mix_ends_among_rows_without_id(spark):
    got = mixing.mix(documents(spark, [(None, "w w w w", "a")] * 900).repartition(4), total_share=0.3).collect()
    assert sum(r.taken for r in got) == 1080


# 9: near duplicates


def plain_components(rows, words, percent):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], len(sets[k]), least.get(find(k)) if r[0] is not None else None) for k, r in enumerate(rows)]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_all_pairs(spark, words):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [r for r in ODD if r[0] != 5]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 60, 200]))]
        for k in range(rng.randint(1, 7)):
            own = [rng.choice(vocabulary) if rng.random() < 0.006 * k else w for w in base]
            rows.append((1000 - 10 * g + k, " ".join(own), "a"))
    got = near_dedup.near_duplicates(documents(spark, rows).repartition(3), words=words).collect()
    want = plain_components(rows, words, 80)
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, want))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_near_duplicates_never_broadcast_sets_or_signatures(spark, monkeypatch, limit):
    rng, sent, tables, broadcast, summarised = random.Random(4), [], {}, F.broadcast, near_dedup.summarised
    monkeypatch.setattr(F, "broadcast", lambda table: sent.append(table.columns) or broadcast(table))
    monkeypatch.setattr(near_dedup, "summarised", lambda table, name: tables.setdefault(name, summarised(table, name)))
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", limit)
    rows = [(k, f"{k} alone {k * k}", "a") for k in range(30)] + [(90, "7 alone 49", "a")]
    for g in range(1, 4):
        base = [f"v{rng.randrange(300)}" for _ in range(120)]
        rows += [(100 * g + k, " ".join(w if rng.random() > 0.004 * k else f"x{rng.randrange(300)}" for w in base), "a") for k in range(3, 9)]
    got = near_dedup.near_duplicates(documents(spark, rows).repartition(3), words=2).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, plain_components(rows, 2, 80)))
    assert not [c for c in sum(sent, []) if "signature" in c or "members" in c]
    assert tables["named"].rows <= 19  # not the texts that are alone


def test_a_key_is_shared_at_the_distance_limit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, near_dedup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(near_dedup.SYMBOLS, near_dedup.MOST_WRONG, replace=False)] ^= 1
        assert set(near_dedup.keys_of(a)[0]) & set(near_dedup.keys_of(b)[0])


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["class"]: r.component for r in near_dedup.components(chain).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# 10: addresses


def test_url_rules_and_reputation(spark):
    urls = [
        None, "no scheme", "http://", "https://A.Example.ORG/es/x?q", "http://example.org/en/1#f", "http://x.example.org/en/2", "http://notexample.org",
        "http://notexample.org/x", "http://a.com/fr/1", "http://a.com/de/1", "http://a.com/de?x=/de/", "http://bad.net/1", "http://good.net/1", "http://new.net", "ftp://h.net:80/p?://q",
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, "http://bad.net/2", 1)] + [(500 + k, f"http://{'bad' if k % 2 else 'good'}.net/{k}", 1) for k in range(80)], "page_id long, url string, host int")
    outcomes = spark.createDataFrame([(500 + k, k % 2 == 1) for k in range(80)] + [(11, None), (None, True)], "page_id long, bad boolean")
    rows = url_filter.judge_urls(pages, outcomes).collect()
    assert len(rows) == len(urls) + 81
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id is not None and r.page_id < 100}
    assert got[0] == got[1] == ("", "", None, got[0][3]) and got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/1", "example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][:3] == ("notexample.org", "", None) and got[7][2] == "org/"
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block") and got[10][:3] == ("a.com", "/de", None)
    assert got[11][3] == "block" and got[12][3] == "allow" and got[14][:2] == ("h.net:80", "/p")
    assert {r.verdict for r in url_filter.judge_urls(pages, outcomes.limit(0)).collect() if r.rule is None} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
