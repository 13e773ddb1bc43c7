import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import spans
from marginalia.functions import text as T


def run(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_tokens(spark):
    assert run(spark, T.tokens, "今天学习了 Python 的 async/await 机制") == [*"今天学习了的机制", "python", "async", "await"]
    assert run(spark, T.tokens, "Étion abc123 Foo_bar 42") == ["tion", "abc123", "foo_bar", "123", "42"]
    assert run(spark, T.tokens, "") == []
    assert run(spark, T.tokens, None) == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab Z9_é今天\n-٣", max_size=60), min_size=20, max_size=20))
def test_tokens_like_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("r")).collect()
    for t, r in zip(texts, rows, strict=True):
        low = t.lower()
        assert r["r"] == re.findall("[一-鿿]", low) + re.findall("[a-z][a-z0-9_]{0,20}", low) + re.findall(r"\d+", low)


def test_wiki_links(spark):
    assert run(spark, T.wiki_links, "a [[ One ]] [[two\nlines]] [[]] [[x]]") == ["One", "x"]


def test_previews(spark):
    assert run(spark, lambda c: T.preview(c, 3), "abcd") == "abc..."
    assert run(spark, lambda c: T.preview(c, 4), "abcd") == "abcd"
    assert run(spark, lambda c: T.preview(c, 9, True), "abcd") == "abcd..."
    assert run(spark, lambda c: T.preview(c, 9, True), "") == ""


def test_ids_of_stems(spark):
    want = {"20260412-0150293323": "202604120150293323", "202604120150293323-": "202604120150293323", "202604120150293323-some-english-slug": "202604120150293323", "202604120150293323": "202604120150293323", "readme": None, "20260412": None, "202604-12015029323": None}
    for stem, i in want.items():
        assert run(spark, T.id_of_stem, stem) == i


def test_slug(spark):
    assert run(spark, T.slug, "Hello, Wörld foo!") == "hello-wörld-foo"


def test_tags(spark):
    df = spark.createDataFrame([(["python", "编程"],), (["python"],), (None,)], "tags array<string>")
    assert df.filter(T.has_all_tags(F.col("tags"), ["python"])).count() == 2
    assert df.filter(T.has_all_tags(F.col("tags"), ["python", "编程"])).count() == 1
    assert df.filter(T.has_all_tags(F.col("tags"), ["none"])).count() == 0


def test_tokens_by_bytes(spark):
    rng = random.Random(6)
    some = "aabzÉİ_09 -.\n一鿿䷿ꀀ，丁A４٣𝟗😀K"
    texts = ["".join(rng.choice(some) for _ in range(rng.choice((0, 1, 4, 12, 90)))) for _ in range(400)]
    texts += ["a" * 21 + "9" * 30 + "_b" + "c" * 50, "9" * 40 + "_" * 30, "z" * 63, "".join(chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000)]
    low = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.lower("t").alias("low"), T.tokens(F.col("t")).alias("want")).orderBy("i").toArrow()
    column = low.column("low").combine_chunks()
    for part in (column, column[7:300]):
        found, rows = spans.tokens(part, spans.digits(spark))
        assert len(found) == len(rows)
        got: dict = {}
        for r, x in zip(rows.tolist(), found.to_pylist(), strict=True):
            got.setdefault(r, []).append(x)
        start = 7 if len(part) < len(column) else 0
        assert [got.get(r, []) for r in range(len(part))] == low.column("want").to_pylist()[start : start + len(part)]


def test_lowered(spark):
    lower = spark.sparkContext._jvm.org.apache.commons.lang3.StringUtils.lowerCase
    every = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]
    assert {a: b for a, b in zip(every, lower("\n".join(every)).split("\n"), strict=True) if re.search("[ -~]", b)} == spans.LOWER
    texts = ["AİB K9_Z@[ Kelvin ÉTÉ 学X", "", "ΑΣ ZZ٣", "İ"]
    for part, own in ((pa.array(texts), texts), (pa.array(texts, pa.large_string()).slice(1, 2), texts[1:3])):
        want = spans.tokens(pa.array([lower(t) for t in own]), spans.digits(spark))
        found = spans.tokens(spans.lowered(part), spans.digits(spark))
        assert found[0].to_pylist() == want[0].to_pylist() and found[1].tolist() == want[1].tolist()


def test_words_after_long_runs_of_digits(monkeypatch):
    """A word begins at the first letter of its run, however far; near ones are found without a list of all letters."""
    low = pa.array(["7a1 __b 12 9_9_c d", "1" * 40 + "e" + "2" * 30 + " " + "_" * 50, "x" * 30 + "_" * 20 + "y"])
    want = [t for x in low.to_pylist() for t in re.findall("[a-z][a-z0-9_]{0,20}", x)]
    digits = [t for x in low.to_pylist() for t in re.findall(r"\d+", x)]
    assert sorted(spans.tokens(low, np.zeros(0, np.int64))[0].to_pylist()) == sorted(want + digits)
    lists = []
    monkeypatch.setattr(spans.np, "searchsorted", lambda a, *b, keep=np.searchsorted, **c: lists.append(len(a)) or keep(a, *b, **c))
    spans._words(spans._KINDS[np.frombuffer(b"7a1 __b 12 9_9_c d", np.uint8)], np.zeros(19, bool))
    assert not lists
