"""Chat formatting, token files, licences, chunks, WARC, fingerprints and decontamination."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywick.functions import uris
from tallywick.llm import chat_format, chunk_dedup, decontaminate, license_scan, queries, range_coder, syncmers, token_binary, warc_derive

LONG = " ".join(f"word{i}" for i in range(150_000))


# chat formatting


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit(1)).withColumn("x", F.lit("own"))
    made = chat_format.format_conversations(turns, piece=4)
    return {r.conv_id: r for r in made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("spans")).alias("loss")).collect()}


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>\n", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "x", "\n", "é", " ", "<\\s>", "[\\\\INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "</s>", ""]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(25) for t in range(rng.randint(1, 14))]
    got = formatted(spark, rows)
    for c in range(25):
        mine = [(r, t) for k, _, r, t in rows if k == c]
        assert [(x.role, x.text) for x in got[c].turns] == mine
        assert got[c].loss == "".join(t for r, t in mine if r == "assistant")


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 1, "assistant", LONG), (2, 5, "assistant", "x"), (2, 5, "assistant", "x")]
    got = formatted(spark, rows)
    assert [(x.role, x.text) for x in got[1].turns] == [("user", "first"), ("", ""), ("user", "a"), ("user", "b")]
    assert got[None].loss == LONG and got[2].loss == "xx"
    assert got[2].formatted.count("<s>") == 1  # adjacent turns of one role share a header
    assert formatted(spark, []) == {}


# token files


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, range_coder.MAX_ID) | st.integers(0, 3), max_size=300), st.sampled_from([1, 7, 64]))
def test_range_coder_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    model, payloads = range_coder.encode_blocks(ids, block)
    assert range_coder.decode_blocks(model, payloads, len(ids), block).tolist() == ids.tolist()
    if len(ids) >= 2 * block:  # a block decodes without the others
        assert range_coder.decode_blocks(model, payloads[1:2], block, block).tolist() == ids[block : 2 * block].tolist()


def test_range_coder_round_trip_over_rebuilt_tables():
    rng = np.random.default_rng(3)
    ids = np.where(rng.random(9000) < 0.7, rng.integers(0, 90, 9000), rng.integers(0, range_coder.MAX_ID + 1, 9000)).astype(np.uint32)
    model, payloads = range_coder.encode_blocks(ids, 2048)
    assert range_coder.decode_blocks(model, payloads, len(ids), 2048).tolist() == ids.tolist()


def test_range_coder_learns():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50_000, 64), 64).astype(np.uint32)
    assert sum(map(len, range_coder.encode_blocks(ids, 4096)[1])) < len(ids) / 2


def test_frames_are_smaller_than_deflated_blocks(spark):
    t = queries._tokenizer()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    ids = np.frombuffer(b"".join(t.encode(r.text or "") for r in rows), "<u4")
    size, block = len(token_binary.pack_frame(ids, np.array([len(ids)]))), token_binary.BLOCK
    assert size < sum(len(zlib.compress(ids[k : k + block].astype("<u2").tobytes())) for k in range(0, len(ids), block))


def test_frames_detect_damage():
    ids = np.arange(5000, dtype=np.uint32) % 97
    frame = bytearray(token_binary.pack_frame(ids, np.array([2000, 3000])))
    back, lengths = token_binary.unpack_frame(bytes(frame))
    assert back.tolist() == ids.tolist() and lengths.tolist() == [2000, 3000]
    for at in (-40, 2, 40, 100, len(frame) // 2):
        frame[at] ^= 1
        with pytest.raises(ValueError):
            token_binary.unpack_frame(bytes(frame))
        frame[at] ^= 1
    for size in (0, 10, 60, len(frame) - 40):
        with pytest.raises(ValueError):
            token_binary.unpack_frame(bytes(frame[:size]))


def untouched():
    """The library's tokenizer of the same file, as it is."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def dealt(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_tokenizer_equals_the_librarys():
    t, plain = token_binary.PieceTokenizer(queries.tokenizer_path()), untouched()
    rng = random.Random(5)
    odd = ["a  b", " x", "x ", "\n\nx", "a\tb", "it's we'll\n 5%", "", " ", "\n", "é x", "<|endoftext|> a", "a <|endoftext|> b", "a\x85b", "x\x1cy", "a_b __ _", "½ x²", "I'm they'd ''s", "日本語 テスト、1", "x\r\ny"]
    odd += ["".join(rng.choices(["a", "bc", " ", "\n", "'s", "9", "!", "é", "_", "<|endoftext|>", "\u00a0", "語"], k=rng.randint(1, 30))) for _ in range(400)]
    assert [t.encode(x) for x in odd] == [dealt(plain, x) for x in odd]
    assert np.frombuffer(t.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_pieces_of_every_plain_character_equal_the_librarys():
    first = untouched().pre_tokenizer
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and token_binary._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 20_000
    for k in range(0, len(plain), 100):
        text = "".join(f"a{c}b {c}1{c}{c} {c}" for c in plain[k : k + 100])
        want = [len(shown) for shown, _ in first.pre_tokenize_str(text)]
        latin = token_binary._PLAIN_LATIN.fullmatch(text)
        assert k or latin
        for parts in (token_binary._PIECES, *([token_binary._LATIN_PIECES] if latin else [])):
            assert [len(p.encode()) for p in parts.findall(text)] == want


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_tokenizer_with_more_pieces_than_its_table(limit):
    t, plain = token_binary.PieceTokenizer(queries.tokenizer_path(), limit=limit), untouched()
    for text in ("a b", "c", "a d e", "f g h a", "b", "a", "x\ty", LONG[:5000], "a h"):
        assert t.encode(text) == dealt(plain, text)
        assert len(t.pieces) <= limit and len(t.pieces.old) <= limit


@pytest.mark.parametrize("partitions", [1, 3])
def test_token_files(spark, make, tmp_path, partitions):
    rows = [(7, "b a"), (3, None), (5, ""), (5, "x"), (None, "n"), (9, LONG[:200_000]), (1, "a\nb")]
    path = str(tmp_path / "ids")
    token_binary.write_ids(make(rows), path, queries._tokenizer, 2, frame_ids=50, partitions=partitions)
    got = token_binary.read_ids(spark.read.parquet(path)).orderBy("start").collect()
    t, at = untouched(), 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_empty(spark, make, tmp_path):
    token_binary.write_ids(make([]), str(tmp_path / "ids"), queries._tokenizer, 2)
    assert token_binary.read_ids(spark.read.parquet(str(tmp_path / "ids"))).count() == 0


# licences


def test_licenses(make):
    mit = license_scan.TEMPLATES["mit-permission"]
    rows = [(1, "prose\nReleased under the MIT License!"), (2, None), (3, ""), (4, mit.replace("charge", "cost") + "\nmore"), (5, "free of charge and under the sun"), (6, LONG + "\n\nAll rights  reserved."), (7, "Released under\nthe MIT License."), (1, "ALL RIGHTS RESERVED")]
    got = {(r.doc_id, r.template): r.n_segments for r in license_scan.license_matches(make(rows)).collect()}
    assert got[(1, "mit-line")] == 3 and got[(1, "all-rights-reserved")] == 1 and got[(4, "mit-permission")] and got[(6, "all-rights-reserved")] and got[(7, "mit-line")]
    assert {k for k, _ in got} == {1, 4, 6, 7}
    assert license_scan.license_matches(make([])).count() == 0


def test_whole_licences_cut_ones_and_sentences(make):
    t = license_scan.TEMPLATES
    wrapped = "\n".join(" ".join(t["mit"].split()[i : i + 9]) for i in range(0, len(t["mit"].split()), 9))
    three = "\n\n".join(t[k] for k in ("mit-permission", "mit-notice", "mit-disclaimer"))
    cut = " ".join(t["bsd-3-clause"].split()[:-25])
    rows = [(1, "Copyright 2020 A. Person\n\n" + wrapped), (2, f"def f():\n\n{three}\n\n" + LONG), (3, cut), (4, "Copyright 2020 Foo. All rights reserved. More of it follows here."), (5, "all rights reserved " * 500)]
    got = {(r.doc_id, r.template) for r in license_scan.license_matches(make(rows)).collect()}
    assert {(1, "mit"), (2, "mit-permission"), (2, "mit-notice"), (2, "mit-disclaimer"), (3, "bsd-3-clause"), (4, "all-rights-reserved")} <= got
    assert (5, "all-rights-reserved") in got


def test_headers_in_comments(make):
    """Standard headers behind comment marks, parted by lines that hold a mark alone."""
    apache = """# Copyright 2020 A. Person
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() {}
"""
    rows = [(1, apache), (2, gpl), (3, "// Licensed under the MIT license.\nfn main() {}\n"), (4, apache.replace("\n", "\r\n"))]
    got = {(r.doc_id, r.template) for r in license_scan.license_matches(make(rows)).collect()}
    assert {(1, "apache-2.0-notice"), (1, "apache-2.0-terms"), (2, "gpl-3.0-notice"), (2, "gpl-warranty"), (3, "mit-licensed-line"), (4, "apache-2.0-notice"), (4, "apache-2.0-terms")} <= got


def test_license_pruning_is_exact():
    grams = {n: license_scan.template_bigrams(t) for n, t in license_scan.TEMPLATES.items()}
    anchors = set(license_scan.anchor_words(grams, 0.8))
    for g in grams.values():
        low, high = license_scan.bounds(len(g), 0.8)
        for size in range(1, 3 * len(g)):
            best = 2 * min(size, len(g)) / (size + len(g))
            assert (best >= 0.8 - 1e-12) == (low <= size <= high)
        free = [x for x in g if not anchors & set(x.split(" "))]
        assert 2 * len(free) / (len(free) + len(g)) < 0.8


# chunks


def test_cut_points_resist_insertions():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    cuts = set(chunk_dedup.cut_points(data).tolist())
    moved = chunk_dedup.cut_points(np.concatenate([data[:5000], np.frombuffer(b"inserted", np.uint8), data[5000:]]))
    later = {c - 8 for c in moved.tolist() if c > 5100}
    assert later <= cuts and len(later) > 200
    slow = [sum(int(chunk_dedup._GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32 for i in range(100)]
    assert chunk_dedup.gear_hashes(data)[:100].tolist() == slow


def test_cut_points_keep_characters_and_bounds():
    data = np.frombuffer(("é" * 3000).encode(), np.uint8)
    ends = chunk_dedup.cut_points(data)
    assert ends[-1] == len(data) and (ends % 2 == 0).all() and np.diff(ends, prepend=0).max() <= chunk_dedup.MOST + 4


def test_repeats(make):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    passage = text(70)
    rows = [(i, text(120)) for i in range(20)] + [(100 + i, f"{text(30)} {passage} {text(40)}") for i in range(10)] + [(200, None), (201, ""), (202, "short"), (203, LONG), (300, f"{passage}\n{passage}"), (None, passage)]
    docs = make(rows)
    spans = chunk_dedup.repeated_spans(docs).collect()
    assert {s.doc_id for s in spans} == {*range(100, 110), 300}
    texts = dict(rows)
    for s in spans:
        assert texts[s.doc_id][s.start + 16 : s.end - 16] in passage or s.doc_id == 300
        assert s.first_doc == 100 and s.n_docs == 11
    left = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs, chunk_dedup.repeated_spans(docs)).collect()}
    assert left[100] == texts[100] and len(left[105]) < len(texts[105]) - 200 and left[203] == LONG and left[200] is None
    assert chunk_dedup.repeated_spans(make([])).count() == 0


def test_repeats_of_copies_that_share_a_passage(make):
    """Copies 7 and 8 hold a passage of document 3: 7 loses the passage alone, 8 loses everything."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    for size in (400, 60):
        head, passage, tail = text(90), text(size), text(90)
        rows = [(3, f"{text(50)} {passage} {text(50)}"), (7, f"{head} {passage} {tail}"), (8, f"{head} {passage} {tail}"), (9, text(80))]
        texts, docs = dict(rows), make(rows)
        spans = chunk_dedup.repeated_spans(docs)
        of_7 = sorted((s.start, s.first_doc, s.n_docs) for s in spans.filter("doc_id = 7").collect())
        assert [x[1:] for x in of_7] == [(7, 2), (3, 3), (7, 2)]
        left = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs, spans).collect()}
        assert left[3] == texts[3] and left[9] == texts[9] and left[8] == ""
        assert left[7].startswith(head) and left[7].endswith(tail) and len(left[7]) < len(texts[7]) - 4 * size // 2


def plain_spans(rows, min_words=24):
    """Chunk by chunk in plain Python: (id, text) -> spans of shared chunks with min_words, unsplit."""
    holders, chunks = {}, {}
    for row in set(rows):
        raw = (row[1] or "").encode()
        ends = chunk_dedup.cut_points(np.frombuffer(raw, np.uint8)).tolist()
        chunks[row] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    for row in rows:
        for piece in {c for _, _, c in chunks[row]}:
            holders.setdefault(piece, []).append(row)
    out = set()
    for row, pieces in chunks.items():
        run = []
        for a, b, c in [*pieces, (0, 0, b"")]:
            if len(holders.get(c, ())) > 1:
                run.append((a, b, c))
                continue
            if sum(x.count(b" ") + x.count(b"\n") for _, _, x in run) >= min_words:
                out.add((row, run[0][0], run[-1][1]))
            run = []
    return out


def test_spans_of_repeated_ids_equal_brute_force(make):
    """Rows of one id with several texts are documents of their own, and so is a row that is there twice."""
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    passage, other = text(200), text(80)
    for ids in ((1, 2, 3), (1, 2, 2), (2, 2, 2)):
        rows = [(k, f"{text(30)} {passage} {text(40)}") for k in ids] + [(5, text(50)), (7, f"{other} {text(9)}"), (7, f"{text(20)} {other}"), (8, text(90))]
        rows.append(rows[-1])
        docs = make(rows)
        spans = chunk_dedup.repeated_spans(docs).collect()
        texts = {(r.doc_id, h): r.text for r in docs.select("doc_id", "text", chunk_dedup.text_hash("text").alias("h")).collect() for h in (r.h, 0)}
        joined = {}
        for s in sorted(spans, key=lambda s: (s.doc_id, s.text_hash, s.start)):
            row = (s.doc_id, texts[s.doc_id, s.text_hash])
            before = joined.setdefault(row, [])
            if before and before[-1][1] == s.start:
                before[-1] = (before[-1][0], s.end)
            else:
                before.append((s.start, s.end))
        assert {(row, a, b) for row, found in joined.items() for a, b in found} == plain_spans(rows)
        long = [s for s in spans if s.end - s.start > 800]
        assert len([s for s in long if s.doc_id in ids]) == 3
        left = [r.text for r in chunk_dedup.without_repeats(docs, chunk_dedup.repeated_spans(docs)).collect()]
        assert sum(passage[100:400] in t for t in left) == sum(other[100:300] in t for t in left) == 1


# WARC


def test_warc(spark):
    html = '<html><title>A &amp; B</title><!-- <p>x --><script>var t="</p>";</script><p>one<br>two &lt;3</p><a class="k" href="/x?a=1&amp;b=2">l</a><a href="y">m</a></html>'
    rows = [("r1", "http://h.org/d/p?q", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", html), ("r1", "http://h.org/d/p?q", "2020-01-01T00:00:00Z", None, html), (None, None, None, None, None), ("long", "http://h.org", "d", "", "<p>" + LONG)]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string").withColumn("kind", F.lit("own")).withColumn("text", F.lit("own"))
    out = warc_derive.derive(df, ["kind", "text"]).collect()
    assert len(out) == 8 and all(r.text == "own" for r in out)
    by = {(r.kind, r.refers_to): r for r in out}
    links = "outlink: http://h.org/x?a=1&b=2\r\noutlink: http://h.org/d/y\r\n"
    meta, conv = by[("metadata", "r1")], by[("conversion", "r1")]
    assert meta.block in ("title: A & B\r\nhttp-status: \r\n" + links, "title: A & B\r\nhttp-status: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html\r\n" + links)
    assert conv.block == "A & B\none\ntwo <3\nlm"
    assert meta.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest() == conv.source_digest and meta.record_id != conv.record_id
    header = dict(x.split(": ", 1) for x in by[("conversion", "long")].header.split("\r\n") if ": " in x)
    assert header["WARC-Refers-To"] == "long" and header["Content-Length"] == str(len(LONG)) and header["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(LONG.encode()).hexdigest()
    assert by[("conversion", "")].block == "" and by[("metadata", "")].n_links == 0
    assert warc_derive.derive(df.limit(0), []).count() == 0


def test_warc_carries_every_source_header(spark):
    head = "HTTP/1.1 301 Moved\r\nServer: x\r\nLocation: /y\r\nETag: \"a:b\"\r\nX-Long: one\r\n  two\r\nContent-Language: de\r\ncontent-type: text/html\r\n\r\nnot a header: no"
    names = ["Server: x", "Location: /y", 'ETag: "a:b"', "X-Long: one two", "Content-Language: de", "content-type: text/html"]
    df = spark.createDataFrame([("r", "http://h.org/", "d", head, "")], "record_id string, target_uri string, date string, http_headers string, payload string")
    for r in warc_derive.derive(df, []).collect():
        assert [x[20:] for x in r.header.split("\r\n") if x.startswith("WARC-Source-Header: ")] == names
        if r.kind == "metadata":
            assert [x[13:] for x in r.block.split("\r\n") if x.startswith("http-header: ")] == names


@pytest.mark.parametrize("base", ["http://a/b/c/d;p?q", "https://h.org/d/p.html", "http://h.org", "https://h.org/x/?a#f"])
def test_links_resolve_as_the_standard_says(spark, base):
    from urllib.parse import urljoin

    refs = ["g", "./g", "g/", "/g", "//g", "//cdn.org/x", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "http://o.org/a/../b", "mailto:a@b.c", "HTTP://X/", "x/y/../../z/."]
    rows = spark.createDataFrame([(x,) for x in refs], "x string")
    parts = uris.uri_parts(F.lit(base))
    got = {r.x: r.y for r in rows.select("x", uris.resolve(F.col("x"), parts).alias("y")).collect()}
    for x in refs:
        want = urljoin(base, x)
        want = {"HTTP://X/": x, "http://o.org/a/../b": "http://o.org/b"}.get(x, want)  # the standard is stricter
        assert got[x].rstrip("/") == want.rstrip("/"), (base, x)
    assert spark.range(1).select(uris.resolve(F.lit("a/b"), uris.uri_parts(F.lit(""))).alias("y")).first().y == "a/b"


def test_hrefs_in_all_quotes_and_entities(spark):
    html = "<a href='single'>x</a><a class=k href=bare>x</a><a HREF = \"&eacute;&#8217;&#x41;\">x</a><a href=\" a\n b\t \">x</a><a data-href='no'>x</a>&copy;&amp;lt;&nosuch;&#0;&#xD800;&&#;&apos;"
    df = spark.createDataFrame([("r", "http://h.org/d/p", "d", "", html)], "record_id string, target_uri string, date string, http_headers string, payload string")
    by = {r.kind: r.block for r in warc_derive.derive(df, []).collect()}
    assert [x[9:] for x in by["metadata"].split("\r\n") if x.startswith("outlink: ")] == ["http://h.org/d/single", "http://h.org/d/bare", "http://h.org/d/é’A", "http://h.org/d/a b"]
    assert by["conversion"] == "xxxxx©&lt;&nosuch;\ufffd\ufffd&&#;'"


# fingerprints


def brute_syncmers(text, k=syncmers.K, s=syncmers.S):
    points = syncmers.code_points(text)
    h = [int(syncmers._windows(points[i : i + s], (s,))[s][0] >> np.uint64(32)) for i in range(len(points) - s + 1)]
    return [i for i in range(len(points) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def test_syncmers_equal_the_definition_and_are_context_free():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdeé 日", k=400))
    hashes, at = syncmers.anchors(syncmers.code_points(text))
    assert at.tolist() == brute_syncmers(text)
    assert np.diff(at).max() <= syncmers.K - syncmers.S + 1
    inside = syncmers.anchors(syncmers.code_points("other text before it, " + text))[0]
    assert set(hashes.tolist()) <= set(inside.tolist())


def test_fingerprints_of_edits(make):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (5000, 1, 0, 19, 20, 21, 300, 1200)] + [None, LONG, "日本" * 50]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, ""), (None, "zz" * 40)]
    rng.shuffle(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = syncmers.fingerprint_edits(make(rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (syncmers.sketch(syncmers.code_points(x)) for x in (t, changed, nxt))
        want.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), syncmers.to_text(a), syncmers.to_text(b), syncmers.likeness(a, b), syncmers.likeness(a, c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fingerprints_of_equal_texts_and_single_documents(make):
    (one,) = syncmers.fingerprint_edits(make([(4, "only one text")])).collect()
    assert one.near_next == 1.0
    got = syncmers.fingerprint_edits(make([(i, "the same text " * 9) for i in range(30)])).collect()
    assert len({r.fingerprint for r in got}) == 1 and all(r.near_next == 1.0 for r in got) and len(got) == 30
    assert syncmers.fingerprint_edits(make([])).count() == 0


# decontamination


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition: the longest free common run first."""
    free_d, free_i, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < least:
            return total
        n, d, i = best
        free_d[d : d + n], free_i[i : i + n] = [False] * n, [False] * n
        total += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), max_size=25), st.integers(2, 4))
def test_tiles_are_common_free_runs(doc, item, least):
    d, i = np.array(doc, np.uint64), np.array(item, np.uint64)
    tiles = decontaminate.greedy_tiles(d, i, least) if len(d) and len(i) else []
    used_d, used_i = set(), set()
    for a, b, n in tiles:
        assert n >= least and doc[a : a + n] == item[b : b + n]
        assert not used_d & set(range(a, a + n)) and not used_i & set(range(b, b + n))
        used_d |= set(range(a, a + n))
        used_i |= set(range(b, b + n))
    # nothing that could still be a tile is left
    rest = [x if k not in used_d else -1 for k, x in enumerate(doc)]
    other = [x if k not in used_i else -2 for k, x in enumerate(item)]
    assert brute_tiles(rest, other, least) == 0


def test_tiles_equal_the_definition_on_distinct_words():
    rng = random.Random(9)
    for _ in range(40):
        item = rng.sample(range(1, 1000), 30)
        parts = [item[a : a + 6] for a in range(0, 30, 6)]
        rng.shuffle(parts)
        doc = [x for p in parts for x in [*rng.sample(range(1000, 2000), 3), *p]]
        got = sum(t[2] for t in decontaminate.greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 5))
        assert got == brute_tiles(doc, item, 5)


def test_contamination(spark, make):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(6)] + [(6, None), (7, ""), (8, "two words"), (0, "repeated item id has other words in it")]
    w = items[1][1].split()
    mixed = " ".join(w[20:40] + [word() for _ in range(5)] + w[0:20])
    rows = [(1, f"{LONG} {items[0][1].upper()} tail"), (2, mixed), (3, " ".join(w[:15])), (4, None), (5, ""), (6, "has two words here"), (9, "Two, words!"), (7, items[3][1]), (7, items[3][1]), (8, " ".join(word() for _ in range(300)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    docs = make(rows)
    for most in (10, 10_000):  # joined by shuffle, and sent to the tasks
        got = sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in decontaminate.contaminated(docs, bench, broadcast_tokens=most).collect())
        assert got == [(1, 0, 1.0), (2, 1, 1.0), (7, 3, 1.0), (7, 3, 1.0), (9, 8, 1.0)]
        kept = decontaminate.drop_contaminated(docs, bench, broadcast_tokens=most)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(make([]), bench).count() == 0


def test_contamination_of_repeated_items_and_ids(spark, make):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:30])), (1, " ".join(words[30:])), (None, " ".join(words[:30])), (2, "nothing of it")]
    bench = spark.createDataFrame([(5, " ".join(words[:30])), (5, " ".join(words[:30])), (None, " ".join(words[20:50]))], "item_id bigint, text string")
    each = []
    for most in (1, 10_000):
        found = decontaminate.contaminated(make(rows), bench, broadcast_tokens=most).collect()
        each.append(sorted(str((r.doc_id, r.item_id, round(r.coverage, 3), r.n_tiles, r.longest)) for r in found))
        assert [r.doc_id for r in decontaminate.drop_contaminated(make(rows), bench, broadcast_tokens=most).collect()] == [2]
    assert each[0] == each[1] and len(each[0]) == 5


def test_decontamination_query_both_ways(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    sent, joined = (decontaminate.contaminated(docs, bench, broadcast_tokens=n).collect() for n in (10**6, 10))
    assert len(sent) > 3 and sorted(map(str, sent)) == sorted(map(str, joined))
