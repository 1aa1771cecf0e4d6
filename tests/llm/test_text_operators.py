"""Rules, licences, chat, BPE, media and WARC: against SQL, other libraries, brute force or round trips."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwave.llm import byte_bpe, chat_format, license_scan, media, quality_rules, warc
from siftwave.llm.queries import oracle_sql, queries

ODD = ["", None, " \t\n", "a", "a b c a b c a b c", "x " * 3000, "\x85   é ü # * <>|", "same line\nsame line\n\nsame line", "İ ẞ MIT LICENSE mit\nlicense", "apache license apache license version 2 0"]


def odd(spark, sf):
    """Every document of the small table, with odd texts, a null id, repeated rows and a clashing extra column."""
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_001, None), (10_000, "")], "doc_id long, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra).withColumn("words", F.lit(1)).withColumn("n", F.lit("n"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return odd(spark, sf)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def rows(frame, columns):
    return sorted((tuple(None if v != v else v for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["op5_chat", "op9_quality_rules"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, list(got.columns)) == rows(want, list(got.columns))


def measured(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(words) < 400 else {w for w, n in _counts(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [s for s in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def _counts(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def test_quality_measures(docs, texts):
    got = quality_rules.quality_rows(docs).toPandas()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert rows(got, names) == sorted((measured(t) for _, t in texts), key=repr)
    failed = [n < 50 or 100 * w > 50 * n for n, w in zip(got["n_words"], got["n_repeat_words"], strict=True)]
    assert got["base_failed"].tolist() == failed
    assert not (got["base_failed"] & got["kept"]).any()


def test_rules_name_what_is_broken_and_keep_other_columns(spark):
    df = spark.createDataFrame([("the of and " * 40, "q"), ("# " * 60, "r")], "text string, quality string")
    got = quality_rules.score_quality(df, out="verdict").collect()
    assert [r["quality"] for r in got] == ["q", "r"]
    assert "symbols" in got[1]["verdict"]["failed"] and "repeated_windows" in got[0]["verdict"]["failed"]


def test_base_licences(docs, texts):
    got = license_scan.license_rows(docs).toPandas()
    want = []
    for _, t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        at, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert rows(got, ["n_words", "n_base", "first_word", "last_word", "base_labels"]) == sorted(want, key=repr)
    assert got["score"].between(0, 1).all()
    assert all(set(b.split(",")) <= set(a.split(",")) for a, b in zip(got["labels"], got["base_labels"], strict=True) if b)


def test_templates_need_their_key_phrases(spark):
    full = "Licensed under CC BY-NC 4.0."
    df = spark.createDataFrame([(1, "word " * 20 + full), (2, "licensed under some by nc 4 0 terms"), (3, "nothing")] + [(i, f"filler {i}") for i in range(4, 40)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_rows(df).collect()}
    assert got[1] == "cc-by-nc-4.0" and got[2] == "" and got[3] == ""


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted."


def licence_labels(spark, texts):
    got = license_scan.license_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("text,label", [("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), (GRANT, "mit-grant"), (BSD, "bsd"), ("licensed under cc by 4.0", "cc-by-4.0")])
def test_licences_of_a_third_of_the_rows_and_of_one_row(spark, text, label):
    assert licence_labels(spark, [text] * 10 + ["filler of a kind"] * 20) == [label] * 10 + [""] * 20
    assert licence_labels(spark, [text]) == [label]


def test_many_licences_in_one_text(spark):
    mpl = "Subject to the terms of the Mozilla Public License, v. 2.0"
    text = f"{GRANT} x {BSD} y Licensed under CC BY-NC 4.0. z {mpl}"
    assert licence_labels(spark, [text] + [f"filler {i}" for i in range(40)])[0] == "bsd,cc-by-nc-4.0,mit-grant,mpl-2.0" == exhaustive(text)


def exhaustive(text, least=0.6):
    """Labels of every template that fits at any place of a text."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    found = {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in f" {' '.join(words)} "}
    for template in license_scan.TEMPLATES:
        n, keys = len(template.words), template.key_places()
        for at in range(-n, len(words)):
            if all(at + q >= 0 and tuple(words[at + q : at + q + len(k)]) == k for q, k in keys):
                same = sum(0 <= at + q < len(words) and words[at + q] == w for q, w in enumerate(template.words))
                if same >= least * n:
                    found.add(template.label)
    return ",".join(sorted(found))


def test_licences_equal_an_exhaustive_match(docs, texts, spark):
    rng = np.random.default_rng(2)
    planted = []
    for t in license_scan.TEMPLATES:
        for share in (0.0, 0.15, 0.3, 0.5):
            words = [w if rng.random() >= share else f"x{rng.integers(99)}" for w in t.words]
            planted.append("before " + " ".join(words) + " after")
            planted.append(" ".join(words[: int(len(words) * (1 - share))]).upper())
    planted += [" ".join(w for t in license_scan.TEMPLATES for w in (*t.words, "and")), "the " * 500 + license_scan.TEMPLATES[2].text]
    got = licence_labels(spark, planted)
    want = [exhaustive(t) for t in planted]
    assert got == want and len({label for w in want for label in w.split(",") if label}) >= len(license_scan.TEMPLATES)
    assert rows(license_scan.license_rows(docs).toPandas(), ["labels"]) == sorted(((exhaustive(t),) for _, t in texts), key=repr)


def test_chat_layouts_become_the_same_turns(spark):
    said = "a <|im_end|>\n<|im_start|>user\n&lt; [/INST] é😀"
    import json

    records = [
        json.dumps({"prompt": said, "completion": "ok"}),
        json.dumps({"response": "ok", "prompt": said}),
        json.dumps({"instruction": said, "output": "ok"}),
        json.dumps({"messages": [{"content": said, "role": "user"}, {"role": "assistant", "content": "ok"}]}),
        json.dumps({"conversations": [{"from": "user", "value": said}, {"from": "assistant", "value": "ok"}]}),
        json.dumps({"chat": {"turns": [{"speaker": "user", "text": said}, {"speaker": "assistant", "text": "ok"}]}}),
        "{broken",
        json.dumps({"other": 1}),
        None,
    ]
    df = chat_format.canonical_turns(spark.createDataFrame(list(enumerate(records)), "id long, record string"))
    got = {r["id"]: r["turns"] for r in df.collect()}
    assert all([tuple(t) for t in got[i]] == [("user", said), ("assistant", "ok")] for i in range(6))
    assert got[6] is None and got[7] is None and got[8] is None
    out = chat_format.format_turns(df, "id")
    read = {r["id"]: r for r in out.select("*", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in read[0]["t"]] == [("user", said), ("assistant", "ok")]
    (span,) = read[0]["loss_spans"]
    assert read[0]["formatted"][span["start"] : span["stop"]] == "ok" and read[6]["formatted"] == ""


def test_chat_optional_null_and_further_fields(spark):
    import json

    cases = [
        ({"messages": []}, [], "messages"),
        ({"messages": None, "id": 3}, [], "messages"),
        ({"instruction": None, "output": "x"}, [("user", ""), ("assistant", "x")], "instruction"),
        ({"instruction": "do", "input": "this", "output": "x", "system": "be"}, [("system", "be"), ("user", "do\n\nthis"), ("assistant", "x")], "instruction"),
        ({"instruction": "do", "input": "", "output": "x", "meta": {"a": [1, {"b": "}"}]}}, [("user", "do"), ("assistant", "x")], "instruction"),
        ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "y", "name": "n"}], "tools": []}, [("user", ""), ("assistant", "y")], "messages"),
        ({"messages": [{"role": "user"}, None, {"content": 5}]}, [("user", ""), ("", "5")], "messages"),
        ({"prompt": "p", "response": "r", "name": "messages"}, [("user", "p"), ("assistant", "r")], "prompt_response"),
        ({"chat": {"turns": [{"speaker": "user", "text": "q"}], "lang": "en"}}, [("user", "q")], "chat"),
        ({"messages": "no list"}, None, None),
        ({"prompt": "p", "completion": "c", "messages": []}, None, None),
        ([1, 2], None, None),
        ({}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "kept") for i, (r, _, _) in enumerate(cases)], "id long, record string, turns string")
    read = chat_format.canonical_turns(df, out="t")
    got = {r["id"]: r for r in read.collect()}
    for i, (_, turns, layout) in enumerate(cases):
        assert (None if got[i]["t"] is None else [tuple(t) for t in got[i]["t"]], got[i]["layout"], got[i]["turns"]) == (turns, layout, "kept"), cases[i]
    counts = chat_format.layout_counts(read).where("layout is null").groupBy().sum("n").first()[0]
    assert counts == 4
    assert chat_format.canonical_turns(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="told apart"):
        chat_format.canonical_turns(df, mappings=(chat_format.MAPPINGS[0], chat_format._said("again", "prompt", "completion")))


def test_chat_keeps_turns_longer_than_the_json_reader_takes(spark):
    df = spark.createDataFrame([(1, 0, "user", 'q "\\ :'), (2, 0, "user", "x"), (2, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit('a"b\\c:'), 3_500_000).alias("text"))
    got = {r["conv_id"]: r for r in chat_format.chat_rows(df.unionByName(long)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"]) == (2, 21_000_000, 2)
    assert got[1]["loss_sha256"] == hashlib.sha256(b'a"b\\c:' * 3_500_000).hexdigest()


def test_chat_raises_where_a_record_is_lost(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "records_of", lambda c: c.select("conv_id", F.lit("{broken").alias("record")))
    with pytest.raises(Exception, match="no turns could be read"):
        chat_format.chat_rows(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()


def test_bpe_equals_tiktoken_and_decodes(docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = byte_bpe.bpe_rows(docs, path, public_tokenizers.PATTERN).toPandas()
    assert rows(got, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=repr)
    bpe = byte_bpe.load(path, public_tokenizers.PATTERN)
    rng = np.random.default_rng(0)
    for n in (3, 17, 200, 3000):
        for alphabet in ("ab", "aeiounrst", "éß漢字😀"):
            word = "".join(rng.choice(list(alphabet), n))
            assert bpe.encode(word) == other.encode_ordinary(word)


def test_media_round_trip(docs, texts):
    got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"]): r for r in media.media_rows(docs).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i, len(raw), hashlib.sha256(whole).hexdigest()]
        assert r["payload_bytes"] == len(whole) and r["tail_crc32"] == zlib.crc32(whole[-64:])
        boxed = media.mux(whole)
        assert (r["media_bytes"], r["media_sha256"]) == (len(boxed), hashlib.sha256(boxed).hexdigest())


def test_media_metadata_and_broken_containers(spark):
    data = media.mux(bytes(range(256)) * 100)
    (t,) = media.probe(data)
    assert media.read_samples(data, t) == bytes(range(256)) * 100
    rows_ = [(1, data), (2, data[:-9]), (3, b"junk"), (4, None), (5, b"")]
    got = {r["id"]: r for r in media.probe_media(spark.createDataFrame(rows_, "id long, media binary")).collect()}
    (track,) = got[1]["tracks"]
    assert track["codec"] == "raw " and track["n_samples"] == 400 and track["duration"] == 25600
    assert data[track["keyframes"][1]["start"] : track["keyframes"][1]["stop"]] == (bytes(range(256)) * 100)[1024:1088]
    assert all(got[i]["tracks"] is None and got[i]["media_error"] for i in (2, 3, 5))
    assert got[4]["tracks"] is None and got[4]["media_error"] is None


def test_bpe_columns_keep_others_and_replace_their_own(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([("hello world", "old", 1), (None, "old", 2), ("a" * 100_000, "old", 3)], "text string, ids string, decoded int")
    coded = byte_bpe.encode_column(df, path, pattern)
    got = byte_bpe.decode_column(coded, path, pattern).collect()
    assert [bytes(r["decoded"]) for r in got] == [b"hello world", b"", b"a" * 100_000] and coded.columns == ["text", "decoded", "ids"]
    assert [r["decoded"] for r in coded.select("decoded").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode_column(spark.createDataFrame([([10**8],)], "ids array<int>"), path, pattern).collect()


def fragmented(payload: bytes, **how) -> bytes:
    """A container without samples in its tables, and one fragment with a run of 64-byte samples."""
    import struct

    whole = media.mux(bytes(64))
    head = whole[: whole.index(b"mdat") - 4]
    for name in (b"stsz", b"stts", b"stss", b"stsc", b"co64"):
        at = head.index(name) + (12 if name == b"stsz" else 8)
        head = head[:at] + bytes(4) + head[at + 4 :]
    n = len(payload) // 64
    mvex = media._box(b"mvex", media._full(b"trex", struct.pack(">5I", 1, 1, 64, 64, media.NOT_SYNC)))
    at = head.index(b"moov") - 4
    head = head[:at] + struct.pack(">I", struct.unpack_from(">I", head, at)[0] + len(mvex)) + head[at + 4 :] + mvex

    def moof(offset):
        if how.get("sizes"):
            run = media._full(b"trun", struct.pack(">IiI", n, offset, 0), b"".join(struct.pack(">II", 10, 64) for _ in range(n)), flags=0x305)
        else:
            run = media._full(b"trun", struct.pack(">IiI", n, offset, 0), flags=0x5)
        return media._box(b"moof", media._full(b"mfhd", bytes(4)), media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 1), flags=0x20000), run))

    return head + moof(len(moof(0)) + 8) + media._box(b"mdat", payload)


@pytest.mark.parametrize("sizes", [False, True])
def test_media_fragments(sizes):
    payload = bytes(range(256)) * 5
    data = fragmented(payload, sizes=sizes)
    (t,) = media.probe(data + data[data.index(b"moof") - 4 :])
    assert media.read_samples(data + data[data.index(b"moof") - 4 :], t) == payload * 2
    assert t.keys.tolist() == [0, 20] and t.duration == 64 + 40 * (10 if sizes else 64)


def test_media_zero_keyframe_number_and_clashing_columns(spark):
    data = media.mux(bytes(64 * 40))
    at = data.index(b"stss") + 12
    bad = data[:at] + bytes(4) + data[at + 4 :]
    df = spark.createDataFrame([(1, data, "a"), (2, bad, "b")], "tracks long, media binary, media_error string")
    got = media.probe_media(df.withColumnRenamed("tracks", "id").withColumn("tracks", F.lit(0))).collect()
    assert [r["media_error"] is None for r in got] == [True, False] and got[0]["tracks"][0]["n_samples"] == 40
    again = media.add_media(spark.createDataFrame([("x", 1), (None, 2)], "text string, media int")).collect()
    assert [media.read_samples(r["media"], media.probe(r["media"])[0]) for r in again] == [b"x" + bytes(63), bytes(64)]


def test_warc_derivatives_are_linked(spark, sf):
    got = queries()["op4_warc"](spark, sf).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    assert len(got) == 2 * len(pages) and got["record_id"].is_unique
    for page, g in got.groupby("page_id"):
        source = warc.response(page, pages["url"][page], pages["html"][page])
        ((headers, block),) = warc.parse(source)
        assert sorted(g["warc_type"]) == ["conversion", "metadata"]
        assert set(g["refers_to"]) == {headers["warc-record-id"]}
        text = g.set_index("warc_type")["content"]
        assert g.set_index("warc_type")["block_digest"]["conversion"] == warc.digest(text["conversion"].encode())
        assert "source-content-type: text/html; charset=utf-8" in text["metadata"] and warc.digest(block) in text["metadata"]
        assert "<" not in re.sub(r"<(?![a-zA-Z/])", "", text["conversion"]) or "&lt;" in pages["html"][page]


def test_warc_odd_cells(spark):
    good = warc.response(1, "http://a/", "<title>T</title><p>one<p>two &amp; <script>no</script>three")
    other = warc.record("request", {"WARC-Record-ID": "<r>"}, b"x")
    df = spark.createDataFrame([(1, good + other + good), (2, None), (3, b""), (4, other), (5, b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx")], "page_id long, warc binary")
    got = warc.derive_records(df).toPandas()
    assert list(warc.parse(good))[0][0]["warc-type"] == "response"
    assert got["page_id"].tolist() == [1, 1, 1, 1, 5] and got["error"].notna().tolist() == [False] * 4 + [True]
    assert got["content"][1].split("\n") == ["T", "one", "two & three"]


def test_warc_keeps_what_is_whole_in_a_broken_cell(spark):
    good = warc.response(1, "http://a/", "<p>one")
    cells = [good[:-30] + b"\r\n" + good, good + b"junk\r\n" + good, good + good[:80], good.replace(b"Content-Length: ", b"Content-Length: x", 1) + good]
    for cell, errors in zip(cells, (0, 1, 1, 1), strict=True):
        made = warc.derive(cell)
        assert sum(isinstance(x, ValueError) for x in made) >= errors
        assert sum(not isinstance(x, ValueError) and b"conversion" in x for x in made) >= 1
    df = spark.createDataFrame([(1, cells[1], "clash")], "page_id long, warc binary, error string")
    got = warc.derive_records(df).toPandas()
    assert sorted(got["warc_type"].dropna()) == ["conversion", "conversion", "metadata", "metadata"] and got["error"].notna().sum() == 1


def test_warc_decodes_content_and_transfer_codings():
    import gzip

    page = "<p>caf\xe9 one<p>two".encode("latin-1")
    for coding, body in (("", page), ("Content-Encoding: gzip\r\n", gzip.compress(page)), ("Content-Encoding: deflate\r\n", zlib.compress(page)), ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(page)), gzip.compress(page)))):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n{coding}\r\n".encode() + body
        _, text = warc.derive(warc.record("response", {"WARC-Record-ID": "<u>"}, block))
        ((headers, shown),) = warc.parse(text)
        assert shown.decode() == "café one\ntwo" and headers["warc-source-payload-digest"] == warc.digest(body)
    for coding, body in (("Content-Encoding: br", page), ("Content-Encoding: gzip", gzip.compress(page)[:-9]), ("Transfer-Encoding: chunked", b"zz\r\n")):
        (error,) = warc.derive(warc.record("response", {}, f"HTTP/1.1 200 OK\r\n{coding}\r\n\r\n".encode() + body))
        assert isinstance(error, ValueError)


def test_pages_are_read_in_linear_time():
    import time

    for part in ("<!--", "<a href='", "<script>", "<", "<title>", "<html lang", "<p", "</script ", "&#", "<!", "<a b=c "):
        start = time.time()
        warc.read_page(part * (200_000 // len(part)))
        assert time.time() - start < 1.5, part


def test_page_parts():
    page = """<!DOCTYPE html><html LANG='de'><head><title>A &amp; B</title><style>x</style></head><body a="1>"><p>1 < 2<!-- no --> 3<script>if (a<b) {}</script><a href="/x?a&amp;b">L</a><A HREF=y>M</a><br>end <b>bold</b>ly</body>"""
    text, title, language, links = warc.read_page(page)
    assert (title, language, links) == ("A & B", "de", ["/x?a&b", "y"])
    assert text.split("\n")[-2:] == ["1 < 2 3 LM", "end boldly"]
    assert warc.read_page("<script>never closed") == ("never closed", "", "", []) and warc.read_page("") == ("", "", "", [])


@pytest.mark.parametrize("name", ["op2_media", "op3_licenses", "op5_chat", "op9_quality_rules", "op10_byte_bpe", "op4_warc"])
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "conversations", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == (1 if name == "op5_chat" else 0)
