"""Decontamination, language ID, quality, pieces, audio, pages and the pipeline."""

import hashlib
import math
import random
import struct
import tempfile
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import html_extract as H
from quillspark.llm import language_id, mpeg_audio, quality, queries
from quillspark.llm import sentence_pieces as S
from quillspark.llm.decontaminate import infix_distance, leaks, locate, pieces

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def plain_infix(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


# --- decontamination --------------------------------------------------------------------------


def test_infix_distance_matches_a_table():
    r = random.Random(1)
    for _ in range(200):
        p, t = "".join(r.choices("abc", k=r.randint(1, 90))), "".join(r.choices("abc", k=r.randint(0, 120)))
        d, _ = infix_distance(p, t)
        assert d == plain_infix(p, t)
        d, a, b = locate(p, t)
        assert plain_infix(p, t[a:b]) == d


def test_pieces_cover_the_item():
    item = "x" * 101
    found = pieces(item, 0.08)
    assert len(found) == 9 and "".join(p for p, _ in found) == item


def test_leaks_match_brute_force(spark):
    r = random.Random(4)
    words = [f"q{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(words, k=40))) for i in range(8)] + [(90, None), (91, "short"), (None, " ".join(words[:30]))]
    docs = []
    for i in range(40):
        text = " ".join(r.choices(words, k=60))
        if i % 3 == 0:
            item = list(items[i % 8][1])
            for _ in range(r.choice((0, 2, 6, 40))):
                item[r.randrange(len(item))] = r.choice("xyz ")
            text = text[:100] + "\n " + "".join(item).upper() + "  " + text[100:]
        docs.append((i, text))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    got = {(x.id, x.item_id, x.distance) for x in leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    fold = lambda t: " ".join((t or "").lower().split())
    want = set()
    for d, t in docs:
        for i, q in items:
            p = fold(q)
            if len(p) >= 16 and (n := plain_infix(p, fold(t))) <= int(len(p) * 0.08):
                want.add((d, i, n))
    assert got == want
    assert leaks(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    assert leaks(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == 0


def test_documents_are_scanned_once_for_all_blocks_of_items(spark, monkeypatch):
    """Many blocks of items over many portions of text find what one block finds, in one pass."""
    from quillspark.llm import decontaminate as D

    words = "amber basin cedar delta ember fjord grove haven inlet jetty".split()
    items = [(n, " ".join(words[(n + k * k) % 10] + str(n) for k in range(6))) for n in range(40)] + [(None, "  "), (41, None)]
    docs = [(n, f"Before it. {items[n % 40][1].upper()} and {items[(n * 7) % 40][1][:-1]}x") for n in range(60)] + [(None, items[3][1]), (61, None), (62, ""), (63, " ".join(t for _, t in items[:40]) * 3)]
    d, i = frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string")
    want = sorted(map(str, leaks(d, i).collect()))
    assert len(want) > 100
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    monkeypatch.setattr(D, "PORTION_CHARS", 500)
    found = leaks(d, i)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert sorted(map(str, found.collect())) == want

    batches = [pa.record_batch({"id": [1, 2, 3], "body": ["aa", "bbbb", "c"]}), pa.record_batch({"id": [4], "body": ["dd"]})]
    assert [[i for i, _ in p] for p in D.portions(batches, 5)] == [[1, 2], [3, 4]]
    assert [[i for i, _ in p] for p in D.portions(batches, 0)] == [[1, 2, 3], [4]]


def test_leak_spans_point_into_the_original(spark):
    item = "alpha beta gamma delta epsilon zeta"
    text = "Intro…  ALPHA  beta\ngamma delta epsilon zeta! more"
    (x,) = leaks(frame(spark, [(1, text)]), frame(spark, [(5, item)], "item_id long, text string")).collect()
    assert text[x.start : x.end] == "ALPHA  beta\ngamma delta epsilon zeta" and x.distance == 0


def test_short_items_match_whole_words(spark):
    items = [(1, "Cat"), (2, "red green blue"), (3, "3.14"), (4, "你好"), (5, " "), (6, "")]
    docs = [(1, "a  CAT!"), (2, "concatenate 13.145 cats"), (3, "x red\ngreen blues y"), (4, "pi=3.14"), (5, "说你好吗"), (6, "xred green blue"), (7, "scattered green blue"), (8, "cat"), (9, "red gren blu")]
    found = leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    got = {(x.id, x.item_id, x.distance, dict(docs)[x.id][x.start : x.end]) for x in found}
    assert got == {(1, 1, 0, "CAT"), (3, 2, 1, "red\ngreen blues"), (4, 3, 0, "3.14"), (5, 4, 0, "你好"), (6, 2, 1, "xred green blue"), (8, 1, 0, "cat")}


def test_planted_leaks_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, sf).collect()}
    assert want <= got and len(got - want) <= 1


# --- language ID and quality --------------------------------------------------------------------


def test_language_is_right_on_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in truth}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def gram_key(word, n, at=0):
    """The hash of a word (n = 0), or of its n-gram that starts at a place; places count the edge."""
    slab = language_id.Slab([word], language_id.Quick())
    return slab.hashes[0] if n == 0 else slab.grams(np.array([0]), n)[0][at]


def test_language_backs_off_to_shorter_grams():
    rows = [(0, gram_key("haus", 0), [9, 0]), (0, gram_key("maison", 0), [0, 9]), (3, gram_key("ha", 3), [9, 0]), (2, gram_key("ma", 2, 1), [0, 9]), (1, gram_key("z", 1), [5, 1])]
    sizes, grams, counts = zip(*rows)
    model = language_id.Model(["de", "fr"], np.array(grams), np.array(sizes), np.array(counts), {n: [20, 20] for n in range(6)})
    said = [x[0] for x in model.score(["Haus", "haben", "xmax", "z", "Maison 12", "zz ha maison"])]
    assert said == ["de", "de", "fr", "de", "fr", "de"]
    assert model.score([None, "123 !?", "²½", "", "日"]) == [("und", 0.0)] * 4 + [("de", 0.5)]


def plain_language(rows, texts, langs):
    """Word-first backoff with dictionaries: words and n-grams counted from (lang, text) rows."""
    counts = {n: {k: Counter() for k in langs} for n in range(6)}
    words = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()

    def grams(w, n):
        w = f"<{w}>" if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    for lang, text in rows:
        for w in words(text):
            for n in range(6):
                counts[n][lang].update(grams(w, n) if n else [w])
    logs = lambda n, g: np.log([(counts[n][k][g] + 0.1) / (counts[n][k].total() + 1) for k in langs])
    for text in texts:
        total = np.zeros(len(langs))
        for w in words(text):
            if any(counts[0][k][w] for k in langs):
                total += logs(0, w)
                continue
            for n in (5, 4, 3, 2, 1):
                known = [g for g in grams(w, n) if any(counts[n][k][g] for k in langs)]
                if known:
                    total += np.mean([logs(n, g) for g in known], axis=0)
                    break
        best = int(total.argmax())
        yield (langs[best], 1 / np.exp(total - total[best]).sum()) if words(text) else ("und", 0.0)


def test_language_matches_plain_counts(spark):
    r = random.Random(3)
    parts = {"a": "ka lo mi tu éa".split(), "b": "sch ung ei lo".split(), "c": "tion the ou".split()}
    make = lambda k: " ".join("".join(r.choices(parts[k], k=r.randint(1, 3))) for _ in range(r.randint(1, 12)))
    rows = [(i, make(k), k) for i, k in enumerate("abc" * 20)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    tests = [(i, make(k) + r.choice(["", " 12²", "\nQx!"])) for i, k in enumerate("abc" * 30)] + [(900, None), (901, "½"), (902, "x" * 5000)]
    model = language_id.fit(docs, "text", "lang", "doc_id")
    got = {r.id: (r.lang_pred, r.score) for r in language_id.predict(frame(spark, tests), model).collect()}
    for (i, _), (lang, score) in zip(tests, plain_language([(k, t) for _, t, k in rows], [t or "" for _, t in tests], "abc")):
        assert got[i] == (lang, pytest.approx(score, abs=1e-4))
    more = language_id.annotate(docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2)), model, score_name="sure")
    assert more.columns == ["doc_id", "text", "lang", "score", "lang_pred", "sure"]
    assert {x.lang_pred for x in more.collect()} <= set("abc")


def test_language_learns_the_most_frequent_values_of_an_unclean_column(spark):
    rows = [(i, "ka lo", "a") for i in range(6)] + [(10 + i, "sch ung", "b") for i in range(4)] + [(20 + i, "qu", f"stray {i:02}") for i in range(40)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs, "text", "lang", "doc_id", most_langs=3).langs == ["a", "b", "stray 00"]
    two = language_id.fit(docs, "text", "lang", "doc_id", most_langs=2)
    tests = frame(spark, [(1, "lo ka"), (2, "ung"), (3, "qu")])
    assert [r.lang_pred for r in language_id.predict(tests, two).orderBy("id").collect()][:2] == ["a", "b"]


def test_language_edge_cases(spark):
    docs = frame(spark, [(1, None, "en"), (2, "", None), (None, "hello there", "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, "text", "lang", "doc_id")
    assert {(r.id, r.lang_pred) for r in language_id.predict(docs, model).collect()} == {(1, "und"), (2, "und"), (None, "en"), (3, "und")}
    none = language_id.fit(docs.where("false"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, label[r.doc_id]) for r in queries.op10_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9 and sum(s >= 0.3 for s in good) >= 0.98 * len(good)


def plain_ftrl(rows):
    """FTRL with dictionaries, one weight after the other."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for found, y in rows:
            x = {k: c * quality.SCALE / max(1, len(found)) for k, c in Counter(found).items()} | {1 << quality.BITS: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def test_quality_matches_a_plain_loop(spark):
    r = random.Random(17)
    words = "good fine well bad awful click buy now now the a of".split()
    rows = [(i, " ".join(r.choices(words[: 6 + 6 * (i % 2)], k=r.randint(0, 30)))) for i in range(60)]
    labels = [(i, 1 - i % 2) for i in range(50)]
    docs = frame(spark, rows)
    got = {x.id: x.score for x in quality.score(docs, quality.fit(docs, frame(spark, labels, "doc_id long, quality int"))).collect()}
    found = {i: f.tolist() for (i, _), f in zip(rows, quality.features([t.encode() for _, t in rows], quality.Quick()))}
    shards: dict[int, list] = {}
    for x in frame(spark, labels, "id long, y int").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(quality.SHARDS))).collect():
        shards.setdefault(x.shard, []).append((x.id, x.y))
    total: Counter = Counter()
    for part in shards.values():
        part.sort(key=lambda x: (hash((x[0], 1)), x[0]))
        for k, w in plain_ftrl([(found[i], y) for i, y in part]).items():
            total[k] += w * len(part) / len(labels)
    for i, f in found.items():
        dot = total[1 << quality.BITS] + sum(total[k] for k in f) * quality.SCALE / max(1, len(f))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-4)


def test_extra_columns_and_long_texts(spark):
    """Columns with the names that operators use inside, nulls in them, repeated rows, a very long text."""
    schema = "doc_id long, text string, id long, body string, lang string, score double, row string, html string, url string, page_id long, item_id long, y int"
    long = " ".join(f"word{i % 977}" for i in range(150_000))
    rows = [(1, "some text here", 5, "b", "en", 0.1, "r", "<p>x</p>", "http://a/b", 1, 1, 1), (1, "some text here", None, None, None, None, None, None, None, None, None, None), (2, long, 5, "b", "en", 0.1, "r", "<p>y</p>", "http://a/c", 2, 1, 1), (None, None, 1, "", "", 0.0, "", "", "", 3, 2, 0)]
    docs, none = frame(spark, rows, schema), frame(spark, [], schema)
    v = S.Vocabulary.load()
    model = language_id.fit(docs, "text", "lang", "doc_id")
    weights = quality.fit(docs, docs.select("doc_id", F.col("y").alias("quality"), "id", "text"))
    runs = [
        lambda d: S.decode_docs(S.encode_docs(d, v), v), lambda d: S.round_trip(d, v), lambda d: language_id.predict(d, model), lambda d: quality.score(d, weights), lambda d: mpeg_audio.read(mpeg_audio.store(d)),
        lambda d: H.extract(d), lambda d: leaks(d, docs, item_text="body", item_id="item_id").select("id").distinct().unionAll(d.select("doc_id")),
    ]
    for k, run in enumerate(runs):
        assert run(docs).count() >= len(rows) and run(none).count() == 0, k
    (text,) = [x.text for x in S.decode_docs(S.encode_docs(docs, v), v).collect() if x.id == 2]
    assert text == long
    page = "<body>" + "<p>same</p>" * 20_000 + "<p>own</p></body>"
    out = H.extract(frame(spark, [(1, "http://h/a", page), (2, "http://h/b", page.replace("own", "other"))], "page_id long, url string, html string"))
    assert {x.page_id: x.text[-5:] for x in out.collect()} == {1: "e\nown", 2: "other"}


def test_quality_edge_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "a b"), (3, "x " * 50_000)])
    weights = quality.fit(docs, frame(spark, [(1, None), (None, 1)], "doc_id long, quality int"))
    assert not weights.any()
    assert {(r.id, r.score) for r in quality.score(docs, weights).collect()} == {(1, 0.5), (2, 0.5), (None, 0.5), (3, 0.5)}
    weights = quality.fit(docs, frame(spark, [(1, 1), (2, 1), (3, 0), (3, 1), (3, 0)], "doc_id long, quality int"))
    scores = {r.id: r.score for r in quality.score(docs, weights).collect()}
    assert scores[1] == scores[2] > scores[3]


# --- pieces -------------------------------------------------------------------------------------

ODD = ["", "a", " ", "  x   y ", "\n\n a\n", "x\0y\0", "🙂 é́ﬁ\ttab", "a" * 130, "def f(x):\n    return x\n        y", "你好世界 the theme", " " * 40 + "z", "<s> </s> <0x41>"]


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    v = S.Vocabulary.load()
    encoder, back = S.Encoder(v), S.Decoder(v)
    r = random.Random(8)
    texts = ODD + ["".join(r.choices("the aeiou\n é語🙂.,", k=r.randint(1, 300))) for _ in range(200)]
    got = encoder.encode(texts)
    assert got.to_pylist() == sp.encode(texts)
    assert back.decode(got) == texts


def test_pieces_query_round_trips(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_sentence_pieces(spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
    v = S.Vocabulary.load()
    out = S.decode_docs(S.encode_docs(frame(spark, [(1, None), (None, ""), (2, "a▁b")]), v), v).collect()
    assert {(r.id, r.text) for r in out} == {(1, None), (None, ""), (2, "a b")}
    assert S.encode_docs(frame(spark, []), v).count() == 0


# --- audio --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [b"", b"x", b"hello" * 1000, bytes(range(256)) * 200, b"\xff\xfb" * 3000, "é語🙂".encode() * 999])
def test_audio_round_trip(text):
    payload = mpeg_audio.payload_of(text)
    data = mpeg_audio.write_stream(payload)
    s = mpeg_audio.read_stream(data)
    assert s.body == payload and len(payload) % 64 == 0 and payload and not s.bad and not s.skipped
    assert s.vbr["frames"] == len(s.offsets) and s.vbr["bytes"] == len(data) - mpeg_audio.read_tag(data)[1]
    assert s.samples == 1152 * len(s.offsets) and s.duration == Fraction(s.samples, 44100)


def test_audio_resynchronises_and_verifies():
    data = mpeg_audio.write_stream(b"payload " * 400)
    whole = mpeg_audio.read_stream(data)
    at = whole.offsets[1]
    noisy = mpeg_audio.read_stream(data[:at] + b"\xff\x00junk" + data[at:] + b"TAG" + bytes(125))
    assert noisy.body == whole.body and noisy.skipped == 6 and noisy.id3v1
    broken = bytearray(data)
    broken[whole.offsets[0] + 8] ^= 1
    assert mpeg_audio.read_stream(bytes(broken)).bad == 1
    assert mpeg_audio.read_stream(b"no audio here").offsets == []


@pytest.mark.parametrize(
    ("head", "bits"),  # bits: allocation and selection that the checksum covers, behind the two header bytes
    [
        ("fffe90c4", "1" * 128),
        ("fffe9004", "1" * 256),
        ("fffe9074", "1" * 192),
        ("fffc8004", "1" * (2 * 88 + 2 * 2 * 27)),
        ("fffc8054", "1" * (2 * 32 + 56 + 2 * 2 * 27)),
        ("fffc2004", "0" * 46 + "111111" + "1010"),
        ("fff480c4", "0" * 4 + "1" * (75 - 4) + "1" * (2 * 29)),
    ],
)
def test_audio_verifies_layers_one_and_two(head, bits):
    head = bytes.fromhex(head)
    h = mpeg_audio.Header(head, 0)
    crc = 0xFFFF
    for b in f"{int.from_bytes(head[2:], 'big'):016b}" + bits:
        crc = (crc << 1 & 0xFFFF) ^ 0x8005 * (crc >> 15 ^ int(b))
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    frame = (head + crc.to_bytes(2, "big") + body).ljust(h.size, b"\0")
    s = mpeg_audio.read_stream(frame * 3)
    assert (s.checked, s.bad, len(s.offsets)) == (3, 0, 3)
    broken = bytearray(frame * 3)
    broken[h.size + 6] ^= 128
    assert mpeg_audio.read_stream(bytes(broken)).bad == 1


def test_audio_free_format_and_foreign_bodies():
    def frame(pad, fill):
        return bytes((0xFF, 0xFB, pad << 1, 0xC0)) + b"\xff\xfb\0\xc0" + bytes([fill]) * (492 + pad)

    data = frame(0, 1) + frame(1, 2) + frame(0, 3) + frame(1, 4)
    s = mpeg_audio.read_stream(b"junk" + data)
    assert s.offsets == [4, 504, 1005, 1505] and s.skipped == 4 and s.duration == Fraction(4 * 1152, 44100)
    assert s.body == b"".join(frame(p, f)[21:] for p, f in ((0, 1), (1, 2), (0, 3), (1, 4)))
    foreign = (bytes.fromhex("fffb90c0") + b"\0\3").ljust(417, b"x")
    assert mpeg_audio.read_stream(foreign * 2).body == foreign[21:] * 2


def id3(version, flags, body):
    return b"ID3" + bytes((version, 0, flags)) + mpeg_audio._syncsafe(len(body)) + body


def test_audio_tags_of_all_versions():
    utf16 = b"\1" + "é\0".encode("utf-16") + "x".encode("utf-16")
    frame4 = lambda name, body, flag=0: name + mpeg_audio._syncsafe(len(body)) + bytes((0, flag)) + body
    frame3 = lambda name, body: name + len(body).to_bytes(4, "big") + b"\0\0" + body
    long = b"\0" + b"t" * 300
    cases = [
        (id3(4, 0, frame4(b"TIT2", long) + frame4(b"TXXX", utf16) + bytes(9)), {"TIT2": "t" * 300, "é": "x"}, 0),
        (id3(4, 0x50, mpeg_audio._syncsafe(6) + b"\1\0" + frame4(b"TALB", b"\3\xc3\xa9")) + b"3DI" + bytes(7), {"TALB": "é"}, 0),
        (id3(4, 0, frame4(b"TALB", b"\0\0\0\4\0\xff\0b", 3)), {"TALB": "ÿb"}, 0),
        (id3(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + frame3(b"TPE1", b"\2" + "é".encode("utf-16-be"))), {"TPE1": "é"}, 0),
        (id3(3, 0x80, frame3(b"TPE1", b"\0a\xffb").replace(b"\xff", b"\xff\0")), {"TPE1": "aÿb"}, 0),
        (id3(2, 0, b"TT2" + (3).to_bytes(3, "big") + b"\0hi"), {"TT2": "hi"}, 0),
    ]
    for data, want, _ in cases:
        assert mpeg_audio.read_tag(data + b"rest") == (want, len(data))


def test_audio_seek_tables_and_gaps():
    s = mpeg_audio.read_stream(mpeg_audio.write_stream(bytes(range(256)) * 600))
    assert s.seek(0) == (0, s.offsets[0]) and s.seek(10**6) == (len(s.offsets) - 1, s.offsets[-1])
    n = len(s.offsets) // 2
    assert s.seek(Fraction(1152 * n, 44100)) == (n, s.offsets[n]) and s.table_error() <= s.vbr["bytes"] // 256 + 1 and s.played == s.duration

    def frame(body):
        return (b"\xff\xfb\x90\xc0" + bytes(17) + body).ljust(417, b"\0")

    vbri = b"\xff\xfb\x90\xc0" + bytes(32) + b"VBRI" + bytes(6) + (417 * 5).to_bytes(4, "big") + (4).to_bytes(4, "big") + struct.pack(">4H", 2, 1, 2, 2) + struct.pack(">2H", 417 * 3, 834)
    s = mpeg_audio.read_stream(vbri.ljust(417, b"\0") + frame(b"x") * 4)
    assert s.vbr["kind"] == "VBRI" and s.vbr["seek"] == [0, 1251] and s.vbr["frames_per_entry"] == 2 and s.table_error() == 417
    lame = b"Info" + struct.pack(">I", 1) + (3).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 100).to_bytes(3, "big")
    s = mpeg_audio.read_stream(frame(lame) + frame(b"y") * 3)
    assert s.duration == Fraction(3456, 44100) and s.played == Fraction(3456 - 676, 44100)


@pytest.mark.parametrize("tag", ["12x", "-5", "", "99999999999", "٣"])
def test_audio_length_tags_that_are_none(tag):
    assert mpeg_audio._stated(tag, 640) == 640
    assert mpeg_audio._stated("64", 640) == 64


def test_audio_features_name_the_stream(spark):
    media = mpeg_audio.store(frame(spark, [(1, "abc")]))
    (row,) = mpeg_audio.read(media).collect()
    assert row.feature.startswith("layer3 44100 mono")
    (none,) = mpeg_audio.read(media.withColumn("media", F.lit(b"no frame here"))).collect()
    assert none.feature.startswith("no frames") and none.payload_bytes == 0


def test_audio_query(spark, sf):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_mpeg_audio(spark, sf).collect():
        payload = mpeg_audio.payload_of(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    out = mpeg_audio.read(mpeg_audio.store(frame(spark, [(None, None), (1, ""), (1, "")]))).collect()
    assert len(out) == 3 and len({(r.payload_bytes, r.media_sha256) for r in out}) == 1
    assert mpeg_audio.read(mpeg_audio.store(frame(spark, []))).count() == 0


# --- pages --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">Cookies <p>ok</p></div>
<article><h1>Head &amp; more</h1><p><b>One   two<br><p>Three&nbsp;four &lt;five&gt;</p><form>Name</form><aside>Side</aside><div class="comments"><p>Nice!</p></div><ul><li>x</li><li>y</li></ul></article>
<footer>&copy; host</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE, None) == "Head & more\nOne two\nThree four <five>\nx\ny"
    assert H.main_text("", None) == "" and H.main_text("plain < text &amp; more", None) == "plain < text & more"
    assert H.main_text("<article><p>cut <b>off", None) == "cut off"
    assert H.main_text("<nav>menu<article><p>body</p>", None) == "body"


def test_shared_lines_go_where_no_region_is_declared():
    a = "<div>Site name</div><p>Own one</p><div>Share this</div>"
    b = "<div>Site name</div><p>Other</p><div>Share this</div>"
    theirs = [H.line_hash(t) for t, _ in H.lines(b)]
    assert H.main_text(a, theirs) == "Own one"
    assert H.main_text(a, [H.line_hash(t) for t, _ in H.lines(a)]) == "Site name\nOwn one\nShare this"


def test_own_lines_beside_a_main_region_stay_and_agreed_lines_in_it_go():
    def page(own, copied=""):
        return f"<div>Site name</div><p>Lead {own}</p><article><p>Card {own}</p><p>{copied}</p><p>Read more</p></article><p>Body {own}</p><div>Share this</div>"

    def hashes(*pages):
        return [[H.line_hash(t) for t, _ in H.lines(p)] for p in pages]

    a = page("one", "Quoted")
    first, *rest = hashes(page("two", "Quoted"), page("three"), page("four"))
    assert H.main_text(a, first, rest) == "Lead one\nCard one\nQuoted\nBody one"
    assert H.main_text(a, first, rest[:1]) == "Lead one\nCard one\nQuoted\nRead more\nBody one"
    assert H.main_text(a, first, [rest[0], *hashes(a)]) == "Lead one\nCard one\nQuoted\nRead more\nBody one"
    assert H.main_text(a, None).splitlines()[:2] == ["Site name", "Lead one"]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_extract_asks_neighbours_across_borders(spark, parts):
    def page(own):
        return f"<p>Lead {own}</p><article><p>Text {own}</p><p>Tail {own}</p><p>Read more</p></article><p>Share this</p>"

    rows = [(i, f"https://h.example/a/{i:03}", page(i)) for i in range(30)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = {r.page_id: r.text for r in H.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    ends = {0, 29}  # these have two neighbours only
    assert out == {i: f"Lead {i}\nText {i}\nTail {i}" + "\nRead more" * (i in ends) for i in range(30)}


def test_a_template_goes_however_much_of_the_page_it_is():
    site = [f"<p>site line {i}</p>" for i in range(10)]
    mine, other = "".join([*site, "<p>my own line</p>"]), "".join([*site, "<p>theirs</p>"])
    seen = [H.line_hash(t) for t, _ in H.lines(other)]
    assert H.main_text(mine, seen) == "my own line"
    whole = [H.line_hash(t) for t, _ in H.lines(mine)]
    assert H.main_text(mine, whole).count("\n") == 10  # a copy tells nothing
    article = "<article><p>a</p><p>b</p></article>"
    copy = [H.line_hash(t) for t, _ in H.lines("<p>menu two</p>" + article)]
    assert H.main_text("<p>menu</p>" + article, copy, [copy] * 3) == "menu\na\nb"


def test_shared_is_a_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(300):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 14))], [r.randint(0, 5) for _ in range(r.randint(0, 14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = sorted(H.shared(a, b))
        assert len(got) == table[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_shared_takes_long_pages_of_equal_lines():
    import time

    began = time.perf_counter()
    a, b = [1, 2] * 10_000, [1] * 15_000 + [2, 3] * 2_000
    assert len(H.shared(a, b)) == 10_001
    assert H.shared([7] * 20_000, [7] * 9_000) >= set(range(9_000)) and time.perf_counter() - began < 20


def test_labels_are_read_as_whole_names():
    page = '<article><div class="related-work">A</div><p id="share-prices">B</p><p class="no-comment">C</p><div class="x ad-slot-2">D</div><div id=comments>E</div><section role="complementary">F</section></article>'
    assert H.main_text(page, None) == "A\nB\nC"


def test_the_partner_decides_what_goes_inside_an_article():
    """Notices, menus and comment boxes without any label, the same on neighbouring pages."""

    def page(i):
        return f"<article><div>Home News Contact</div><h1>Title {i}</h1><p>Text {i}</p><p>This site uses cookies.</p><p>More {i}</p><div>Leave a reply</div></article>"

    hashes = [[H.line_hash(t) for t, _ in H.lines(page(i))] for i in range(4)]
    assert H.main_text(page(0), hashes[1], hashes[2:]) == "Title 0\nText 0\nMore 0"
    assert len(H.main_text(page(0), None).splitlines()) == 6


def test_extract_pairs_neighbours_of_a_host(spark):
    def page(own):
        return f"<div>Top bar</div><p>{own}</p><p>and {own} again</p><div>Bottom bar</div>"

    rows = [(i, f"https://h.example/{'ab'[i % 2]}/{i}", page(f"text {i}")) for i in range(40)] + [(100, "https://other.example/x", page("alone")), (101, None, None), (None, "https://h.example/a/1", page("no id")), (102, "http://[bad", "<p>x</p>")]
    out = {r.page_id: r.text for r in H.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"text {i}\nand text {i} again" for i in range(40))
    assert out[100].startswith("Top bar") and out[101] == "" and out[None].startswith("Top bar") and out[102] == "x"
    assert H.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_extract_query_gives_the_articles(spark, sf):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(h.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- pipeline -----------------------------------------------------------------------------------


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentence_pieces"]


def test_each_stage_takes_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, component long"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, None, None, None), (None, "hello world", "en", "s", 11, 1, "r", 1), (2, "", "en", "s", 0, 1, "r", 1), (3, long, "en", "s", 1, 1, "r", 1), (4, long, "en", "s", 1, 1, "r", 1), (4, long, "en", "s", 1, 1, "r", 1), (5, "123", "en", "s", 3, 1, "r", 1)]
    docs = frame(spark, rows, schema)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    kept = {n: f(spark, docs, sf) for n, f in corpus_pipeline.STAGES}
    for name, out in kept.items():
        if name != "sentence_pieces":
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES and dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), sf).count() == 0
    have = ids(docs)
    assert ids(kept["language_id"]) == [x for x in have if x[1] not in (1, 2, 5)]
    assert ids(kept["line_dedup"]) == have and ids(kept["decontaminate"]) == have and ids(kept["sentence_pieces"]) == have
    assert ids(kept["near_dedup"]) == [x for x in have if x[1] != 4]


def test_pipeline_matches_brute_force(spark, sf):
    from llm import brute

    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs, at = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        at[name] = {r.doc_id: r for r in docs.collect()}
    assert set(at["language_id"]) == {i for i, r in truth.items() if any(c.isalpha() for c in r.text or "")}
    want = {i for i, _, c, kept in brute.near([(i, r.text) for i, r in at["line_dedup"].items()], 5, 80) if kept}
    assert set(at["near_dedup"]) == want
    leaked = {i for i, r in at["near_dedup"].items() if any(t in r.text for t in items)}
    assert leaked and not leaked & set(at["decontaminate"]) and len(at["near_dedup"]) - len(at["decontaminate"]) - len(leaked) <= 1
    for i, r in at["sentence_pieces"].items():
        assert r.decoded_sha256 == hashlib.sha256(at["decontaminate"][i].text.encode()).hexdigest()
    ran = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: r.decoded_sha256 for r in ran.collect()} == {i: r.decoded_sha256 for i, r in at["sentence_pieces"].items()}
