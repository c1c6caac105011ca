import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import common, secrets
from termweave.llm.trigrams import ALL, trigram_query

PLAIN = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def plain(text):
    order = list(PLAIN)
    spans = [(m.start(), order.index(k), m.end()) for k, (p, flags, good) in PLAIN.items() for m in re.finditer(p, text or "", flags) if good(m)]
    return sorted(spans)


TEXTS = [
    None, "", "nothing", "é😀 password = hunter22 x", "token=token: abcdef", "PassWD:'abc' secret:abcdef", "api_key==abcdef apikey: \"ABCDEF\"", "token=api_key: abcdef",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 16, "f" * 23, "0f" * 12, "G" + "a" * 30 + "G", "secret=" + "ab" * 15 + " tail", "ſecret: abcdefgh", "toKen: abcdefgh",
    "password=abc\npassword = \n x", "w " * 20_000 + "secret: abcdef1", "secret=aaaaaa" * 300, "password='AKIA" + "Z" * 16 + "'",
]


def test_base_spans_are_those_of_plain_scans(spark):
    rng = random.Random(4)
    bits = ["password", "PASSWD", "token", "secret", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "abc", "AKIA", "Z9" * 9, "0a1b" * 7, "é", "😀", "\n", "x"]
    texts = TEXTS + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, TEXTS[3], "clash")], "doc_id long, text string, secret_spans string")
    out = secrets.scan(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert [(s.start, s.kind, s.stop) for s in r.secret_spans if s.kind < 3] == plain(r.text), r.text
    assert secrets.scan(df.limit(0)).count() == 0


def test_many_candidates_go_by_a_bitmap(spark, monkeypatch):
    """Beyond what is broadcast: rows that the bitmap rules out stay, copies of a candidate are dealt over tasks, columns keep their names."""
    monkeypatch.setattr(secrets, "fits", lambda df: False)
    monkeypatch.setattr(common, "HUB", 4)
    monkeypatch.setattr(secrets, "BITMAP_BITS", 2**16)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + ["token=abcdef1"] * 30 + [f"plain {i}" for i in range(200)])]
    df = spark.createDataFrame(rows, "key long, text string, may string")
    out = secrets.scan(df, column="found").collect()
    assert sorted(r.key for r in out) == [r[0] for r in rows] and all(r.may == "clash" for r in out)
    for r in out:
        assert [(s.start, s.kind, s.stop) for s in r.found if s.kind < 3] == plain(r.text), r.text


def test_more_kinds_and_description(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "zA1g" * 10 + " xoxb-1234567890ab eyJhbGciOi.no eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.scan(df).select("*", secrets.described(F.col("secret_spans")).alias("d"), secrets.redacted(F.col("text"), F.col("secret_spans")).alias("r")).head()
    assert [x.split(":")[0] for x in r.d.split(",")] == ["private_key", "github", "slack", "jwt"]
    assert r.r == "[secret] [secret] [secret] eyJhbGciOi.no [secret]"


def test_digest(spark):
    df = spark.createDataFrame([(1, "x password: abcdefg")], "doc_id long, text string")
    r = secrets.scan(df).select(F.sha2(secrets.described(F.col("secret_spans")).cast("binary"), 256).alias("h")).head()
    assert r.h == hashlib.sha256(b"assign:2:19").hexdigest()


def test_queries_of_patterns():
    sets = lambda p: {frozenset(c) for c in trigram_query(p)}
    assert sets("abcd") == {frozenset({"abc", "bcd"})}
    assert sets("ABC|xyz") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert sets("abc.*xyz") == {frozenset({"abc", "xyz"})}
    assert sets("ab[cd]e") == {frozenset({"abc", "bce"}), frozenset({"abd", "bde"})}
    assert sets("ab+c") == {frozenset()} or all("ab" in "".join(c) for c in sets("ab+c"))
    assert trigram_query("[0-9a-f]{24,}") == ALL == trigram_query("a*") == trigram_query("(abc)?")


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "ab", "cde", "[ab]", "[a-f]", "."]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda t: f"(?:{t[0]}|{t[1]})"), x.map(lambda s: f"(?:{s})?"), x.map(lambda s: f"(?:{s})+"), x.map(lambda s: f"(?:{s}){{2,}}"), x.map(lambda s: f"(?:{s})*")), max_leaves=8), st.text(alphabet="abcdeX", max_size=14))
def test_every_match_meets_its_query(pattern, text):
    if re.search(pattern, text):
        assert any(all(g in text.lower() for g in clause) for clause in trigram_query(pattern))
