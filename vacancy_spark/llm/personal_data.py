"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span
classifier learns from the result.

Candidates are the spans of the plain patterns (e-mail and IP addresses, card and phone numbers), what
fails their checks, parts of that (a phone and a card number that one pattern took together), and
looser forms: spelt-out addresses ("jane [at] example dot com"), defanged IPs, IPv6, cards of other
lengths and separators, phone numbers without a plus. Each candidate gets a vote (for, against,
none) of every labeler of its kind: patterns, gazetteers (top-level domains, card issuers, calling
codes, address blocks) and the words around it. Votes are counted by pattern over all candidates, and
expectation-maximisation estimates from the counts how reliable each labeler is and how likely each
pattern of votes is a real span. A logistic classifier over hashed features of a span and its
surroundings learns those probabilities from a sample of about TRAIN_SPANS candidates for each kind
and form (by a hash, so that reruns agree), and scores every candidate.

Spans of the plain patterns that pass their checks are always kept. Others are added from a score of
ADD_FROM on, the better one first, where they overlap no span that is kept already. Places are code
points, the end exclusive. Whole texts are read, in time that grows with their length alone.

A null or empty text has no spans. Null and repeated ids are passed on; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import documents, narrow_batches, stored

KINDS = ("email", "ip", "card", "phone")
TRAIN_SPANS = 4000  # candidates of one kind and form that the classifier is fitted to, about
ADD_FROM = 0.8  # spans beyond the plain patterns are added from this score on
FEATURES = 1 << 13
EPOCHS = 120
AROUND = 48  # characters on either side that labelers and features look at

SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>"
FOUND = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"

# Gazetteers (fixed values).
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at eu us ca au nz jp cn in br "
                    "mx ar cl pl se no dk fi pt ie cz ru za example test invalid".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 "
                          "64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 "
                          "420 421 852 886 966 971 972".split())
ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})$|5[1-5]\d{14}$|2[2-7]\d{14}$|3[47]\d{13}$|3(?:0[0-5]|[68]\d)\d{11}$"
                     r"|6(?:011|5\d\d)\d{12}$|35\d{14}$|6[0-9]\d{14,17}$")
# Groups of digits that cards are written in.
CARD_GROUPS = ((13,), (14,), (15,), (16,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
# Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": frozenset("email mail mailto e-mail contact write reach address correo courriel kontakt".split()),
    "ip": frozenset("ip ips server host address addr ping client gateway dns login from".split()),
    "card": frozenset("card cards visa mastercard amex credit debit cc pan payment carte tarjeta karte "
                      "kreditkarte".split()),
    "phone": frozenset("phone tel telephone call calls mobile cell fax whatsapp sms ring dial number telefon "
                       "teléfono telefono téléphone handy ruf".split()),
}
AGAINST = frozenset("isbn issn doi order invoice version v ver release section chapter figure page token id uuid sha "
                    "commit serial tracking sku article part ref no lot".split())

# -- plain patterns -----------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    """Every character is looked at twice at most, however long a run of them is."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free, True
        at = text.find("@", free)


def _addresses(text: str):
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), []
        for part in m.group().split("."):
            parts = [*parts, (at, part)] if part else []
            at += len(part) + 1
            if len(parts) == 4:
                right = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in parts)
                yield parts[0][0], at - 1, right
                parts = []


def _cards(text: str):
    for m in _DIGITS.finditer(text):
        n = m.end() - m.start()
        digits = m.group().replace(" ", "").replace("-", "") if 12 < n < 40 else ""
        if n > 12:
            yield m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str):
    for m in _PLUS.finditer(text):
        n = sum(c.isdigit() for c in m.group()) if m.end() - m.start() < 100 else len(_NOT_DIGIT.sub("", m.group()))
        yield m.start(), m.end(), 8 <= n <= 15


def plain_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether its check holds) of every match of the plain patterns, in order."""
    return [(k, *span) for k, find in enumerate((_emails, _addresses, _cards, _phones)) for span in find(text)]


# -- looser candidates ----------------------------------------------------------------------------

_AT = r"(?:\s?[\[({<]\s?(?:[aA][tT]|@)\s?[\])}>]\s?|\s[aA][tT]\s|\s?@\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:[dD][oO][tT]|\.)\s?[\])}>]\s?|\s[dD][oO][tT]\s|\.)"
_SPELT = re.compile(rf"[A-Za-z0-9](?<![A-Za-z0-9._%+-].)[A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}"
                    rf"(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}(?![A-Za-z0-9@-])")
_SPELT_MARK = re.compile(r"[\s\[({<]\s?(?:[aA][tT]\s?[\])}>]|[dD][oO][tT][\s\])}>]|@[\s\])}>])")
_DEFANGED = re.compile(rf"[0-9](?<![0-9A-Za-z.].)[0-9]{{0,2}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9])")
_SIX = re.compile(r"[0-9A-Fa-f](?<![0-9A-Za-z:].)[0-9A-Fa-f]{0,3}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
_GAP = r"\N{NO-BREAK SPACE}\N{HYPHEN}-\N{EN DASH}"  # next to the ASCII separators
_LONG_NUMBER = re.compile(rf"[0-9](?<![0-9A-Za-z+.].)(?:[ ./_{_GAP}-]{{0,2}}[0-9]){{12,18}}(?![0-9A-Za-z])")
_NO_PLUS = re.compile(rf"[0-9(](?<![0-9A-Za-z+(.].)[0-9 ().{_GAP}/-]{{5,22}}[0-9](?![0-9A-Za-z])")


def _loose(text: str):
    if _SPELT_MARK.search(text):
        for m in _SPELT.finditer(text):
            if not re.fullmatch(r"[^\s\[\](){}<>]*", m.group()):
                yield 0, m.start(), m.end()
        for m in _DEFANGED.finditer(text):
            yield 1, m.start(), m.end()
    elif "[.]" in text or "(.)" in text:
        for m in _DEFANGED.finditer(text):
            yield 1, m.start(), m.end()
    if ":" in text:
        for m in _SIX.finditer(text):
            yield 1, m.start(), m.end()
    for m in _LONG_NUMBER.finditer(text):
        yield 2, m.start(), m.end()
    for m in _NO_PLUS.finditer(text):
        if 7 <= sum(c in "0123456789" for c in m.group()) <= 15:
            yield 3, m.start(), m.end()


def _parts(kind: int, text: str, a: int, b: int):
    """Spans inside a match that fails its check: neighbours that one pattern took together."""
    if kind == 3:  # the number up to some space
        n, last = 0, a
        for m in re.finditer(r"[^ ]+", text[a:min(b, a + 200)]):
            n += len(_NOT_DIGIT.sub("", m.group()))
            if n > 15:
                break
            end = a + m.start() + len(m.group().rstrip("().-"))
            if n >= 8 and end > last:
                yield 3, a, end
            last = end
    if kind == 2:  # groups as cards have them
        groups = [(m.start() + a, m.end() + a) for m in re.finditer(r"[0-9]+", text[a:b])]
        sizes = [y - x for x, y in groups]
        for i in range(len(groups)):
            for shape in CARD_GROUPS:
                if tuple(sizes[i:i + len(shape)]) == shape:
                    yield 2, groups[i][0], groups[i + len(shape) - 1][1]


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all candidates: kept ones of the plain patterns (base), then the others."""
    plain = plain_spans(text)
    if not plain and not re.search(r"[0-9]", text) and not _SPELT_MARK.search(text):
        return []
    kept = {(k, a, b) for k, a, b, right in plain if right}
    failed = [(k, a, b) for k, a, b, right in plain if not right]
    others = {x for x in failed if x[2] - x[1] < 100} | set(_loose(text)) | {x for f in failed for x in _parts(f[0], text, *f[1:])}
    free = sorted(others)
    if kept and free:  # of the kept spans that begin before a candidate's end, the furthest end
        taken = np.array(sorted((a, b) for _, a, b in kept), np.int64)
        furthest = np.append(-1, np.maximum.accumulate(taken[:, 1]))
        before = np.searchsorted(taken[:, 0], [b for _, _, b in free])
        free = [x for x, far in zip(free, furthest[before]) if far <= x[1]]
    return [(*x, True) for x in sorted(kept)] + [(*x, False) for x in free]


# -- labelers ---------------------------------------------------------------------------------------

def _sides(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text[max(0, a - AROUND):a].lower())
    after = re.findall(r"[^\W\d_]+", text[b:b + AROUND].lower())
    return before[-4:], after[:2]


def _groups(span: str) -> list[int]:
    return [len(x) for x in re.findall(r"[0-9]+", span)]


def _yes(x: bool) -> int:
    return 1 if x else -1


def votes(kind: int, span: str, base: bool, before: list[str], left: str) -> list[int]:
    """Each labeler's vote: 1 for, -1 against, 0 none. ``left``: the characters before the span."""
    name, digits, groups = KINDS[kind], _NOT_DIGIT.sub("", span), _groups(span)
    near = 1 if FOR[name].intersection(before) else -1 if AGAINST.intersection(before[-2:]) else 0
    code = -1 if re.search(r"[=\"'#$/\\_]\s?$", left) and not base else 0
    if name == "email":
        top = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        marked = bool(re.search(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]", span, re.I))
        return [int(base), int(marked) or -int(not base and " at " in span.lower() and " dot " not in span.lower()),
                _yes(top in DOMAINS), near, code]
    if name == "ip":
        parts = re.findall(r"[0-9A-Fa-f]+", span)
        six = ":" in span
        small = not six and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
        low = not six and all(len(x) == 1 for x in parts)
        return [int(base), _yes(six or small), -1 if low or parts[0] == "0" else int(not six), near, code]
    if name == "card":
        shape = len(groups) == 1 or tuple(groups) in CARD_GROUPS
        return [int(base), _yes(luhn(digits)), _yes(bool(ISSUERS.match(digits))), _yes(shape), near, code]
    dates = bool(re.fullmatch(r"(?:\d{4}[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ]\d{4})(?:[ -]+\d+)*", span))
    abroad = re.sub(r"^(?:\+|00)", "", re.sub(r"[^0-9+]", "", span)) if span[0] == "+" or digits[:2] == "00" else ""
    if abroad:
        known = _yes(any(abroad[:n] in CALLING_CODES for n in (1, 2, 3)))
    else:
        known = _yes(bool(re.fullmatch(r"\(?1?\)?[ .-]?\(?[2-9]\d\d\)?[ .-]{1,2}[2-9]\d\d[ .-]\d{4}", span))
                     or bool(re.fullmatch(r"\(?0[1-9]\d{1,4}\)?(?:[ ./-]\d{2,8}){1,4}", span)))
    return [int(base), known, -1 if dates or len(groups) == 1 or max(groups) > 8 else int(len(digits) >= 9), near, code]


VOTERS = 6  # the most labelers that a kind has


def _packed(vote: list[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(vote))


def _unpacked(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(VOTERS)]


def features(kind: int, span: str, vote: list[int], before: list[str], after: list[str]) -> list[int]:
    """Hashed features of a span and its surroundings."""
    k, groups = KINDS[kind], _groups(span)
    found = [k, f"{k} n {sum(groups)}", f"{k} shape {groups[:8]}", f"{k} first {span[0] if not span[0].isalpha() else 'a'}",
             f"{k} between {sorted(set(re.sub('[A-Za-z0-9]', '', span)))}", f"{k} letters {bool(re.search('[A-Za-z]', span))}",
             *(f"{k} vote {i} {v}" for i, v in enumerate(vote) if v),
             *(f"{k} before {w}" for w in before[-3:]), *(f"{k} after {w}" for w in after)]
    return sorted({zlib.crc32(f.encode()) % FEATURES for f in found})


def _look(text: str) -> list[dict]:
    out = []
    for k, a, b, base in candidates(text):
        span = text[a:b] if b - a < 400 else text[a:a + 200] + text[b - 200:b]
        before, after = _sides(text, a, b)
        vote = votes(k, span, base, before, text[max(0, a - 4):a])
        out.append({"kind": k, "start": a, "end": b, "base": base, "votes": _packed(vote + [0] * (VOTERS - len(vote))),
                    "features": features(k, span, vote, before, after)})
    return out


# -- reliabilities ------------------------------------------------------------------------------------

def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 10.0):
    """Expectation-maximisation over patterns of votes (patterns, labelers) and how often each occurs.

    Returns each pattern's probability to be real, each labeler's probabilities (class, labeler,
    vote) and the share of real ones. Labelers start, and are held by ``prior`` pseudo-counts, as
    right in four of five votes that they give.
    """
    n = patterns.shape[1]
    start = np.empty((2, n, 3))
    start[1], start[0] = [.1, .5, .4], [.4, .5, .1]
    table, share = start.copy(), .5
    hit = np.stack([patterns == v for v in (-1, 0, 1)], 2)  # pattern, labeler, vote
    real = np.zeros(len(patterns))
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + (hit * (np.log(table[1]) - np.log(table[0]))).sum((1, 2))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for c, p in ((0, 1 - new), (1, new)):
            seen = ((p * counts)[:, None, None] * hit).sum(0) + prior * start[c]
            table[c] = seen / seen.sum(1, keepdims=True)
        share = float(((new * counts).sum() + 1) / (counts.sum() + 2))
        if np.abs(new - real).max(initial=0) < 1e-9:
            break
        real = new
    return new, table, share


class Classifier:
    """Logistic regression over hashed features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def learn(cls, rows: list[list[int]], target: np.ndarray, decay: float = 1e-4) -> Classifier:
        """Fitted to probabilities, by whole-sample steps whose size adapts to each feature."""
        weights, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
        at = np.array([f for r in rows for f in r], np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        for _ in range(EPOCHS if rows else 0):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at], len(rows)), -50, 50)))
            slope = np.bincount(at, (p - target)[row], FEATURES) / len(rows) + decay * weights
            seen += slope**2
            weights -= 0.5 * slope / np.sqrt(seen)
        return cls(weights)

    def score(self, row: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[row].sum(), -50, 50))))


# -- Spark ----------------------------------------------------------------------------------------------

def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: every text's candidates with their votes and features, as a written table."""
    narrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([
        ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
        ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])))])

    def run(batches):
        for b in batches:
            spans = [_look(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, schema.field(1).type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id long, spans array<{SPAN}>"), "personal-candidates")


def learn(found: DataFrame, train_spans: int = TRAIN_SPANS) -> Classifier:
    """The span classifier, from the candidates of ``find_candidates``.

    Votes are counted over all candidates: the driver gets one row for each pattern of votes
    (at most 3**VOTERS a kind and form). The sample has about ``train_spans`` of each kind and form.
    """
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    seen = spans.groupBy("kind", "base", "votes").count().collect()
    real: dict[tuple, float] = {}
    strata: dict[tuple, int] = {}
    for k in range(len(KINDS)):
        own = sorted((r for r in seen if r.kind == k), key=lambda r: (r.votes, r.base))
        if own:
            p, _, _ = reliabilities(np.array([_unpacked(r.votes) for r in own]), np.array([float(r["count"]) for r in own]))
            real |= {(k, r.votes): x for r, x in zip(own, p.tolist())}
        for r in own:
            strata[k, r.base] = strata.get((k, r.base), 0) + r["count"]
    # 2**32 equal parts of a hash: each kind and form gives up the parts that hold about its share
    part = F.pmod(F.xxhash64("doc_id", "kind", "start", "end"), F.lit(1 << 32))
    share = F.lit(0)
    for (k, base), n in strata.items():
        upto = (1 << 32) if n <= train_spans else int((1 << 32) * train_spans / n)
        share = F.when((F.col("kind") == k) & (F.col("base") == base), F.lit(upto)).otherwise(share)
    rows = sorted((r.kind, r.votes, list(r.features))
                  for r in spans.where(part < share).select("kind", "votes", "features").collect())
    return Classifier.learn([r[2] for r in rows], np.array([real[r[0], r[1]] for r in rows]))


def _kept(spans: list[dict], model: Classifier, add_from: float) -> list[dict]:
    out = [{**s, "score": model.score(s["features"])} for s in spans]
    kept = [s for s in out if s["base"]]
    taken = np.array([(s["start"], s["end"]) for s in kept], np.int64).reshape(-1, 2)
    for s in sorted((s for s in out if not s["base"] and s["score"] >= add_from),
                    key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["kind"])):
        if not ((taken[:, 0] < s["end"]) & (taken[:, 1] > s["start"])).any():
            taken = np.append(taken, [(s["start"], s["end"])], 0)
            kept.append(s)
    return [{"kind": KINDS[s["kind"]], **{c: s[c] for c in ("start", "end", "base", "score")}}
            for s in sorted(kept, key=lambda s: (s["kind"], s["start"], s["end"]))]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_from: float = ADD_FROM,
                  train_spans: int = TRAIN_SPANS) -> DataFrame:
    """doc_id, spans (kind, start, end, base, score; by kind as in KINDS, then start) of every text."""
    found = find_candidates(docs, id_col, text_col)
    model = learn(found, train_spans)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            spans = [_kept(s, model, add_from) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id long, spans {FOUND}")


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans of all documents, and all spans."""
    found = personal_data(documents(spark, sf_dir))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
