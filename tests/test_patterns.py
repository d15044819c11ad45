"""Translated patterns against Python's own search."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacancy_spark.functions.patterns import PatternError, to_jvm
from vacancy_spark.operators import filters as FL

pytestmark = pytest.mark.filterwarnings("ignore::FutureWarning")

TEXTS = ["", "nurse", "Nurse", "senior nurse", "nurse\n", "nurse\nlead", "a\rb", "a b", "x1", "٣ jobs", "7 jobs",
         "naïve café", "CAFÉ", "straße", "K", "K", "ſ", "é", "e_1", "-", "it's a \"test\"", "a.b", "a\\b", "[x]", "aaa",
         "aaaa", "abab", "abcabc", "foo bar", "foo  bar", "µ", "中文 text", "tab\tbed", "nb sp", "line sep", "^$", "{2}",
         "#hash", "a#b", "x" * 50, "#", "ends with space ", "1234", "12-34", "i", "İ", "ı"]
PATTERNS = [
    "nurse", "(?P<x>nurse)", r"(?P<x>a)(?P=x)", r"\d", r"\d+ jobs", r"\D", r"^\w+$", r"\W", r"\s", r"\S\s\S", r"nurse$", r"nurse\Z",
    r"(?m)^lead$", r"(?m)nurse$", ".", "a.b", "(?s)a.b", r"a\.b", r"\bnurse\b", r"\bcafé", r"é\b", r"\Bé", r"(?i)nurse", "(?i)café",
    "(?i)k", "(?i)s", "(?i)straße", "(?i)[k-m]", "(?i:NURSE) lead", "a{2}", "a{2,}", "a{2,3}?$", "a{,2}b", "a++b", "a*+a", "(?>a+)b", "(ab)+", r"(ab)\1",
    r"(abc)\1$", "x{50}", "x{51}", "[^a-z]", r"[\d_]", r"[^\W\d]", r"[\w-]", r"[]x]", r"[\]]", r"[a\-z]", "[.]", "[[]", "{", "}", r"\{2\}", "(?x) a # b\n b",
    "(?=nurse)", "(?!x)^.", r"(?<=a)b", r"(?<!a)b", "a|b|", "|x", "()", "(?:)", r"\t", r"\x41", r"٣", r"\\", r"\"", "'", "#", "a#b", " ", r"\ ",
    r"(?a)\w\b", r"(?a)\d", r"[^\S\n]", "$", "^", r"\A\Z", r"^\^\$$", "é+", "(a)?b", "(a)|b", "[a-cé-ü]", "(?-i:x)", "中", "[^\\n]$", "\\n", r"\r", "&&", "[a&&b]", "[a-z&&[b]]",
    r"\N{DIGIT SEVEN}", r"(?i)[^k]", r"(?i)µ", r"(?i)ı", r"(?i)i", r"[\x00-\x7f]+$",
]
REFUSED = ["(", "{2}", "[", "a**", r"\q", "(?P<x", r"(a)?(?(1)b|c)", r"(?<=a|bc)d", "(?L)a", "*", "a{3,2}", r"(?P=y)"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").cache()


def found(frame, patterns):
    row = frame.agg(*[F.collect_list(F.when(F.col("t").rlike(to_jvm(p)), F.col("i"))).alias(f"p{n}")
                      for n, p in enumerate(patterns)]).first()
    return [sorted(x) for x in row]


def test_known_patterns(frame):
    assert [p for p in PATTERNS if not compiles(p)] == []
    kept = PATTERNS
    for p, got in zip(kept, found(frame, kept)):
        assert got == [i for i, t in enumerate(TEXTS) if re.search(p, t)], p


def compiles(p):
    try:
        re.compile(p)
        return True
    except re.error:
        return False


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused_on_the_driver(pattern):
    with pytest.raises(PatternError):
        to_jvm(pattern)


def test_random_patterns(frame):
    rng = random.Random(4)
    atoms = ["a", "b", "n", "é", r"\d", r"\w", r"\s", r"\W", ".", "[a-e]", "[^a]", r"\b", "^", "$", r"\.", " ", "nurse", r"[\s\d]"]

    def pattern(depth=0):
        kind = rng.random()
        if depth > 3 or kind < .45:
            return rng.choice(atoms)
        if kind < .7:
            return pattern(depth + 1) + pattern(depth + 1)
        if kind < .8:
            return f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})"
        if kind < .95:
            return f"({pattern(depth + 1)}){rng.choice(['*', '+', '?', '{2}', '*?', '++', ''])}"
        return f"(?{rng.choice(['=', '!', ':', 'i:'])}{pattern(depth + 1)})"
    patterns = [pattern() for _ in range(300)]
    for a in range(0, 300, 100):
        part = patterns[a:a + 100]
        for p, got in zip(part, found(frame, part)):
            assert got == [i for i, t in enumerate(TEXTS) if re.search(p, t)], p


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text("ab1(){}[]|*+?.^$\\dwsbPx<>=!:,-i# \n", max_size=12))
def test_any_text_is_translated_or_refused(text):
    try:
        out = to_jvm(text)
    except PatternError:
        return
    assert compiles(text) and isinstance(out, str)


def test_title_filter(spark):
    df = spark.createDataFrame([("Senior NURSE",), ("٣ Jobs",), ("Other",), (None,)], "title string")
    hits = lambda term: [r.title for r in df.where(FL.title_predicate("title", term)).collect()]
    assert hits(r"\d jobs") == ["٣ Jobs"] and hits("(?P<x>nurse)") == ["Senior NURSE"] and hits("NURSE$") == ["Senior NURSE"] and hits("(?:nurse|other)") == ["Senior NURSE", "Other"]
    with pytest.raises(PatternError):
        FL.title_predicate("title", "(nurse")
    assert [r.title for r in df.where(FL.title_predicate("title", "(nurse", regex=False)).collect()] == []
