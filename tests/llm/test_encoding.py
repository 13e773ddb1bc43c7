import hashlib
import html as html_lib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import media, packing, token_counts, word_bpe

tokenizers = pytest.importorskip("tokenizers")
ODD = [None, "", " \n\t ", "a <|endoftext|> b<|ENDOFTEXT|><|startoftext|>", "Straße ÉCOLE ΑΣ İstanbul ½ ²x\x1cy\x85z w 中文 ́e é", "aaaa" * 5000, "x" * 3000 + " tail", "🙂 ok 'S 's isn't", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[1], rows[5]], "doc_id long, text string, lang string, source string, n_tokens string, ids long")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_like_the_library(library, docs):
    got = word_bpe.encode_decode(docs, keep_ids=True).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        ids = ids_of(library, ODD[r["doc_id"]])
        said = library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == said and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=8, max_size=8))
def test_bpe_on_any_text(library, texts):
    own = word_bpe.load(word_bpe.default_path())
    for t, (ids, said) in zip(texts, own.encode_decode_many(texts), strict=True):
        want = ids_of(library, t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert said.decode() == library.decode(want, skip_special_tokens=False) == own.decode(ids)


@pytest.fixture(scope="module")
def encoders():
    return word_bpe.WordBPE(word_bpe.default_path()), packing.LibraryWords(word_bpe.default_path(), 5000)


LETTERS = st.one_of(st.characters(min_codepoint=0x180, max_codepoint=0x2FF), st.characters(max_codepoint=0x17F), st.sampled_from(["<|", "|>", "<|endoftext|>", "'s", " ", "\x1c", "\u0130"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=24).map("".join), min_size=8, max_size=8))
def test_ids_of_letters_beyond_latin_1(library, encoders, texts):
    own, other = encoders
    for t, (ids, said), raw in zip(texts, own.encode_decode_many(texts), other.encode_many(texts), strict=True):
        want = ids_of(library, t)
        assert np.frombuffer(ids, "<u4").tolist() == want == raw.tolist()
        assert said.decode() == library.decode(want, skip_special_tokens=False)


def test_every_plain_letter_and_its_capital(library, encoders):
    texts = [x for c in range(1, 0x300) for x in (chr(c), f"a{chr(c)}li", f"a<|{chr(c)}x {chr(c)}")]
    own, other = encoders
    for t, (ids, _), raw in zip(texts, own.encode_decode_many(texts), other.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, t) == raw.tolist(), t


def test_tables_survive_a_failure(library, monkeypatch):
    own = word_bpe.WordBPE(word_bpe.default_path())
    list(own.encode_many(["some words"]))
    with monkeypatch.context() as m:
        m.setattr(own, "_learned", lambda keys: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            list(own.encode_many(["some other words here"]))
    assert set(own.index) == {"some", "words"} and not own.index.pending
    (ids,) = own.encode_many(["other some here"])
    assert ids.tolist() == ids_of(library, "other some here")


def test_pairs_by_exact_merging():
    own = word_bpe.WordBPE(word_bpe.default_path())
    rng = random.Random(3)
    left = [t for t in (rng.randrange(49406) for _ in range(3000)) if not own.tokens[t].endswith("</w>") and own._arises(t)]
    right = [t for t in (rng.randrange(49406) for _ in range(3000)) if own._arises(t)]
    n = min(len(left), len(right))
    got = own.compatible(np.array(left[:n]), np.array(right[:n]))
    for a, b, ok in zip(left, right, got.tolist(), strict=False):
        word = own.tokens[a] + own.tokens[b]
        assert (own._merge(word.removesuffix("</w>"), word.endswith("</w>")) == [a, b]) == ok


def test_full_tables_forget(library):
    own, other = word_bpe.WordBPE(word_bpe.default_path(), 5), packing.LibraryWords(word_bpe.default_path(), 5)
    for k in range(6):
        texts = [f"some words {i} and more{i * k} ünï{i}" for i in range(9)]
        for t, (ids, _), raw in zip(texts, own.encode_decode_many(texts), other.encode_many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, t) == raw.tolist()
    assert len(own.index) < 200


def test_packing(library, docs, spark):
    got = packing.pack(docs, length=64, window=256, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["start"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        ids = [*ids_of(library, ODD[r["doc_id"]]), 2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
    copies = {i: 2 if i in (1, 5) else 1 for i in range(len(ODD))}
    for i, n in copies.items():
        assert sum(r["length"] for r in got if r["doc_id"] == i) == n * (len(ids_of(library, ODD[i])) + 1)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or at & (at - 1) == 0
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_schedule_places_every_token_once():
    rng = random.Random(1)
    for _ in range(150):
        totals = {f"s:{i}": rng.choice([0, 1, 5, 17, 999, 12345]) for i in range(rng.randint(1, 6))}
        targets = {q: rng.randint(1, 9) for q in totals} if rng.random() < 0.5 else None
        plan = packing.schedule(totals, targets, rng.choice([7, 64, 1000]))
        places = []
        for q, n in totals.items():
            at = 0
            while at < n:
                k = min(n - at, rng.randint(1, 400))
                places += [p for a, m in plan.runs(q, at, k) for p in range(a, a + m)]
                at += k
        assert sorted(places) == list(range(sum(totals.values()))) and plan.total == len(places)


def test_mixture_in_every_window():
    totals, weights = {"s:a": 60_000, "s:b": 30_000, "s:c": 10_000}, {"s:a": 1, "s:b": 1, "s:c": 2}
    plan = packing.schedule(totals, weights, 1000)
    share: dict = {}
    for q, n in totals.items():
        for a, m in plan.runs(q, 0, n):
            for p in range(a, a + m):
                share[p // 1000, q] = share.get((p // 1000, q), 0) + 1
    for w in range(19):  # until c runs dry
        assert all(abs(share[w, q] - 1000 * weights[q] / 4) <= 2 for q in totals)


def test_mixture_in_every_sequence(spark):
    rows = spark.createDataFrame([(i, "word " * 60, f"s{i % 10}") for i in range(1500)], "doc_id long, text string, source string")
    share: dict = {}
    for r in packing.pack(rows).collect():
        share[r["sequence_id"], r["queue"]] = share.get((r["sequence_id"], r["queue"]), 0) + r["length"]
    whole = sum(share.values()) // packing.LENGTH
    assert whole > 4 and all(abs(share.get((w, f"s:s{q}"), 0) - packing.LENGTH / 10) <= 20 for w in range(whole) for q in range(10))


def test_targets_among_many_sources(spark):
    rows = [(i, "word " * 40, "large" if i % 3 == 0 else "wanted" if i % 60 == 1 else f"s{i}") for i in range(1500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets={"wanted": 10**6}).collect()
    queues = {r["doc_id"]: r["queue"] for r in got}
    assert all(queues[i] == f"s:{source}" for i, _, source in rows if source in ("large", "wanted")) and any(q.startswith("h:") for q in queues.values())
    wanted = [r for r in got if r["queue"] == "s:wanted"]
    assert {r["sequence_id"] for r in wanted} == set(range(max(r["sequence_id"] for r in wanted) + 1))  # first of all, by its large target
    assert sum(r["length"] for r in got if r["sequence_id"] == 0 and r["queue"] == "s:wanted") > 0.5 * min(packing.LENGTH, sum(r["length"] for r in wanted))


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0)).count() == 0


def test_token_attribution(spark, docs):
    got = token_counts.count_tokens(docs).collect()
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for i, text in enumerate(ODD):
        whole, _, bounds = token_counts.sections([("source", "" if i % 3 == 0 else f"s{i % 3}"), ("lang", "en")], text or "")
        offsets = library.encode(whole, add_special_tokens=False).offsets
        n = 2 if i in (1, 5) else 1
        rows = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["section_no"])[::n]
        assert [r["start_char"] for r in rows] == bounds[:-1] and rows[-1]["end_char"] == len(whole)
        assert sum(r["tokens_start"] for r in rows) == sum(r["tokens_majority"] for r in rows) == rows[0]["doc_tokens"] == len(offsets)
        assert abs(sum(r["tokens_share"] for r in rows) - len(offsets)) < 1e-6
        if whole.isascii():
            for r in rows:
                assert r["tokens_start"] == sum(r["start_char"] <= a < r["end_char"] for a, _ in offsets)


def test_boundary_rule():
    # Tokens 0-3, 3-9, 9-10 over sections 0-4, 4-4, 4-10.
    a, m, s = token_counts.attribute(np.array([0, 3, 9, 10]), np.array([0, 4, 4, 10]))
    assert a.tolist() == [2, 0, 1] and m.tolist() == [1, 0, 2] and np.allclose(s, [1 + 1 / 6, 0, 1 + 5 / 6])


def test_media(spark, docs):
    pages = media.interleave(media.as_pages(docs), "doc_id")
    got = media.resolve(pages, media.described(media.store(docs)), "doc_id").collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        raw = (ODD[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(media.to_pgm(payload)).hexdigest() and r["media_bytes"] == len(media.to_pgm(payload))
        assert r["position"] == 1 and r["caption"] == f"Text of document {r['doc_id']}"
    same = [r for r in got if r["doc_id"] in (8, 9)]
    assert same[0]["feature"] == same[1]["feature"]


def test_sequences_of_pages(spark, small, monkeypatch):
    """The pages of the sample tables, with references put into them, against a parse by tags alone and the payloads at hand."""
    monkeypatch.setattr(media, "LOT", 2000)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(9).collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = []
    for k, r in enumerate(spark.read.parquet(f"{small}/pages.parquet").orderBy("page_id").collect()):
        mark = f'<figure><img src="sha256:{digest(texts[k % 9])}" alt="x"><figcaption>Cap {k}</figcaption></figure><img src="sha256:{"0" * 64}" alt="none"><img src="sha256:{digest(texts[0])}">'
        rows.append((r["page_id"], r["html"].replace("</h1>", "</h1>" + mark, 1), "clash", 1))
    rows.append((None, None, "clash", 2))
    rows.append(rows[0])
    features = media.described(media.store(spark.createDataFrame([(t,) for t in texts], "text string")))
    got = media.sequences(spark.createDataFrame(rows, "page_id long, html string, items string, digest int"), features).collect()
    assert sorted(map(str, (r["page_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    blocks = "|".join(sorted(media.BLOCKS, key=len, reverse=True))
    want = {}
    for page, page_html, *_ in rows:
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page_html or "")
        items = []
        for part in re.split(rf"(<figure>.*?</figure>|<img[^>]*>)|</?(?:{blocks})\b[^>]*>", body):
            part = part or ""
            if src := re.search(r'<img src="([^"]+)"(?: alt="([^"]+)")?', part):
                cap = re.search("<figcaption>(.*?)</figcaption>", part)
                items.append(("media", None, src[1], cap[1] if cap else src[2]))
            elif text := " ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", part)).split()):
                items.append(("text", text, None, None))
        want[page] = items
    known = {digest(t): t for t in texts}
    for r in got:
        assert [(i["kind"], i["text"], i["ref"], i["caption"]) for i in r["items"]] == want[r["page_id"]]
        for k, i in enumerate(r["items"]):
            assert i["position"] == k
            t = known.get((i["ref"] or "")[7:])
            payload = media.payload_of(t.encode()) if t is not None else None
            assert (i["payload_sha256"], i["media_bytes"]) == ((hashlib.sha256(payload).hexdigest(), len(media.to_pgm(payload))) if t is not None else (None, None))
    assert any(i["payload_sha256"] for r in got for i in r["items"])


def test_features_by_hand():
    rng = np.random.default_rng(1)
    for n in (64, 128, 64 * 40):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        values = raw.tolist()
        cells = [sum(values[a:z]) * 1000 // max(1, z - a) for a, z in ((k * n // 72, (k + 1) * n // 72) for k in range(72))]
        bits = "".join("1" if cells[9 * r + c + 1] > cells[9 * r + c] else "0" for r in range(8) for c in range(8))
        total, squares = sum(values), sum(v * v for v in values)
        assert media.feature_of(64, n // 64, raw.tobytes()) == f"64x{n // 64};mean={total * 1000 // n};var={(squares * n - total * total) * 100 // (n * n)};dhash={int(bits, 2):016x}"


def test_interleaving(spark):
    html = '<body><p>One &amp; <b>two</b></p><script>var x="<p>no</p>"</script><figure><img src="sha256:ab"><figcaption>Cap <i>x</i></figcaption></figure><img src="u" alt="A"><p>End'
    got = media.parse(html)
    assert got == [["text", "One & two", None, None], ["media", None, "sha256:ab", "Cap x"], ["media", None, "u", "A"], ["text", "End", None, None]]
    df = media.interleave(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert {r["page_id"]: [i["position"] for i in r["items"]] for r in df.collect()} == {1: [0, 1, 2, 3], 2: []}
    unknown = media.resolve(df, media.described(media.store(spark.createDataFrame([("t",)], "text string"))), "page_id").collect()
    assert len(unknown) == 2 and all(r["feature"] is None for r in unknown)


@pytest.mark.parametrize("operator", [word_bpe.encode_decode, token_counts.count_tokens, lambda d: media.described(media.store(d))])
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0
