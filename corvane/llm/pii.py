"""Personal data by weak supervision. Built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, tune, whole_text

#: The base kinds, in order, and what may be their parts. The
#: patterns find the same spans as the plain ones they stand for, but a run is
#: scanned once: it can begin only where no longer run could, and gives nothing
#: back. \G is the end of the match before.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: First names that propose a person where a capitalised word follows.
FIRST_NAMES = "Alice Andrea Anna Carlos Charles Charlotte Daniel David Elena Elizabeth Emma Hans Isabel James Jean Jennifer John Jose Julia Juan Karl Laura Linda Luis Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Sofia Thomas William".split()
#: Words before a name, and before a date of birth, that propose them.
NAME_CUES = ["my name is ", "full name: ", "signed by ", "je m'appelle ", "mein Name ist ", "me llamo "]
BIRTH_CUES = ["born on ", "date of birth: ", "dob: ", "DOB: ", "geboren am ", "né le ", "née le ", "nacido el ", "nacida el "]
#: Kinds that the method adds: keys and passwords after their names or with a
#: known head, addresses in words, national numbers, phones without a plus, and,
#: proposed by gazetteer and context, persons and dates of birth. No pattern
#: bounds a run's length, and none gives a run back.
ADDED = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b)[\x20]*+[=:][\x20]*+[\"']?[A-Za-z0-9_+/=.!@#$%^&*-]{8,}+[\"']?|\b(?:AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+)",
    "address": r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++[\x20]?[(\[][\x20]?(?i:at)[\x20]?[)\]][\x20]?[A-Za-z0-9-]++(?:[\x20]?[(\[][\x20]?(?i:dot)[\x20]?[)\]][\x20]?[A-Za-z0-9-]++)++",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "person": rf"(?<![\p{{L}}'-])(?:(?<={'|'.join(NAME_CUES)})\p{{Lu}}[\p{{L}}'-]++(?:[\x20]\p{{Lu}}[\p{{L}}'-]++)*+|(?:{'|'.join(FIRST_NAMES)})(?:[\x20]\p{{Lu}}[\p{{L}}'-]++)++)",
    "birth": rf"(?=[0-9])(?<={'|'.join(BIRTH_CUES)})[0-9]++(?:[./-][0-9]++[./-][0-9]++|[.]?[\x20]\p{{L}}++[\x20][0-9]++)",
}
#: Cheap signs: a text without any of them does not have the kind.
SIGNS = {"email": ["@"], "ip": ["."], "phone": ["+"], "national": ["-"], "person": [*NAME_CUES, *(f"{n} " for n in FIRST_NAMES)], "birth": BIRTH_CUES}
#: Words that announce a kind within the CONTEXT characters before a span.
CONTEXT = 48
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|addr)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|contact)\b",
    "secret": r"(?i)\b(?:export|env|config|auth|authorization|header|login)\b",
    "address": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "national": r"(?i)\b(?:ssn|social|security|tax|id|number)\b",
    "local": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|contact)\b",
    "person": "(?:" + "|".join(NAME_CUES) + ")$",
    "birth": "(?:" + "|".join(BIRTH_CUES) + ")$",
}
#: Gazetteers: heads or tails that the real thing often has.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:token|secret|password|api|access|AKIA|gh[pousr]_|sk-)",
    "address": r"(?i)(?:com|org|net|edu|de|fr|es|uk)$",
    "national": r"^(?!000|666|9)",
    "local": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "person": rf"^(?:{'|'.join(FIRST_NAMES)})\b",
    "birth": r"(?:19|20)[0-9]{2}$",
}
#: What a match must look like beyond its pattern, for the strict labeler.
STRICT = {
    "email": r"\.[^.]{2,24}$",
    "secret": r"[A-Za-z0-9_+/=.-]{16,}",
    "national": r"^(?!.*(?:-00-|-0000$))",
    "local": r"^(?!([^0-9]*+)([0-9])(?:[^0-9]*+\2)*+[^0-9]*+$)",
    "person": r"\x20",
}
LABELERS = ("regex", "gazetteer", "context", "isolation", "variety")
#: The span classifier's own features, and how many values each has.
FEATURES = {"length": 8, "digits": 5, "marks": 3, "before": 4, "after": 4, "word": 17}
#: Array elements that are folded one by one; runs of them are folded again.
RUN = 64
#: Characters of the blocks that texts are cut from.
BLOCK = 1024


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, start: int, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of all integers before each one, beginning with ``start``.

    Runs of RUN elements are folded by themselves and then their totals, so that
    the arrays that grow stay short.
    """
    none = F.array().cast("array<int>")

    def fold(run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(F.lit(start).alias("at"), none.alias("out")),
            lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )

    def whole(all_values: Column) -> Column:
        count = F.greatest(F.ceil(F.size(all_values) / RUN).cast("int"), F.lit(1))
        runs = F.transform(F.sequence(F.lit(0), count - 1), lambda r: fold(F.slice(all_values, r * RUN + 1, F.lit(RUN))))
        return _bound(runs, lambda rs: F.flatten(F.zip_with(rs, fold(F.transform(rs, lambda r: r["at"]))["out"], lambda r, b: F.transform(r["out"], lambda o: join(b, o)))))

    return _bound(values, whole)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of payment cards holds."""
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        lambda i: F.coalesce(F.substring(F.reverse(digits), i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """What a match of a base kind must also meet."""
    if kind == "ip":
        plain = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(text)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost matches that do not overlap, as (start, end, match, before, after) in
    code points; ``before`` and ``after`` are what stands between the matches.

    What stands between the matches, cut out by the same pattern, tells where
    they are.
    """
    nothing = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def placed(both: Column) -> Column:
        found, between = both["found"], both["between"]
        steps = F.zip_with(found, between, lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g))
        each = F.arrays_zip(found.alias("match"), between.alias("gap"), F.slice(between, F.lit(2), F.size(between)).alias("next"), scan(F.slice(steps, F.lit(1), F.size(found)), 0, lambda a, b: a + b).alias("at"))
        return F.transform(
            F.filter(each, lambda x: x["match"].isNotNull()),
            lambda x: F.struct(
                (x["at"] + F.length(x["gap"])).alias("start"), (x["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("end"), x["match"].alias("match"), x["gap"].alias("before"), x["next"].alias("after")
            ),
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(gate, _bound(both, placed)).otherwise(nothing)


def _kind_of(character: Column) -> Column:
    """0 nothing, 1 a blank, 2 a letter or digit, 3 another mark."""
    return F.when(character == "", 0).when(F.regexp_like(character, F.lit(r"\s")), 1).when(F.regexp_like(character, F.lit(r"[\p{L}0-9]")), 2).otherwise(3)


def _told(kind: str, span: Column) -> dict[str, Column]:
    """What each labeler says of a candidate (1 personal, 0 not, -1 nothing), and
    the features of the span classifier."""
    match = span["match"]
    near = F.substring(span["before"], -CONTEXT, CONTEXT)
    before, after = F.substring(near, -1, 1), F.substring(span["after"], 1, 1)
    symbols = F.array_distinct(F.split(F.regexp_replace(F.substring(match, 1, CONTEXT), r"[^A-Za-z0-9]", ""), ""))
    word = F.regexp_extract(F.lower(near), r"(\p{L}+)[^\p{L}]*$", 1)
    n_digits, n_marks = F.length(_digits(match)), F.length(F.regexp_replace(match, r"[\p{L}0-9]", ""))
    votes = F.struct(
        (F.when(F.regexp_like(match, F.lit(STRICT[kind])), 1).otherwise(0) if kind in STRICT else F.lit(1)).alias("regex"),
        F.when(F.regexp_like(match, F.lit(KNOWN[kind])), 1).otherwise(-1 if kind == "person" else 0).alias("gazetteer"),
        F.when(F.regexp_like(near, F.lit(CUES[kind])), 1).otherwise(-1).alias("context"),
        F.when((_kind_of(before) == 2) | (_kind_of(after) == 2), 0).otherwise(1).alias("isolation"),
        F.when(F.size(symbols) >= 5, 1).when(F.size(symbols) <= 2, 0).otherwise(-1).alias("variety"),
    )
    features = F.struct(
        F.least(F.floor(F.log2(F.length(match) + 0.0)).cast("int"), F.lit(7)).alias("length"),
        F.floor(4 * n_digits / F.length(match)).cast("int").alias("digits"),
        F.least(n_marks, F.lit(2)).alias("marks"),
        _kind_of(before).alias("before"),
        _kind_of(after).alias("after"),
        F.when(word == "", 16).otherwise(F.pmod(F.xxhash64(word), F.lit(16))).cast("int").alias("word"),
    )
    return {"votes": votes, "features": features}


def candidates(text: Column) -> Column:
    """All candidate spans of a text, base kinds first, each with its votes and features."""
    parts = []
    for order, (kind, pattern) in enumerate((BASE | ADDED).items()):
        gate = reduce(or_, [F.contains(text, F.lit(x)) for x in SIGNS[kind]]) if kind in SIGNS else F.regexp_like(text, F.lit(pattern))
        parts.append(_candidates(order, kind, matches(text, pattern, gate)))
    return F.concat(*parts)


def _candidates(order: int, kind: str, spans: Column) -> Column:
    if kind in BASE:
        spans = F.filter(spans, lambda s: valid(kind, s["match"]))
    return F.transform(
        spans,
        lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[c.alias(n) for n, c in _told(kind, s).items()]),
    )


@dataclass
class Reliability:
    """How often each labeler votes how, by expectation-maximisation."""

    prior: dict[str, float]
    rate: dict[str, tuple[list[float], list[float]]]  # P(vote -1, 0, 1 | not personal), P(.. | personal)

    @classmethod
    def fit(cls, patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> "Reliability":
        """From counts of vote patterns, of which there are at most 10 kinds x 3^5.

        Each span is personal or not; a labeler's vote depends on that alone.
        Starts from labelers that are right three times in four when they vote,
        smoothed by one pseudo-count a vote.
        """
        prior = {k: 0.7 for k in (*BASE, *ADDED)}
        model = cls(prior, {l: ([0.2, 0.6, 0.2], [0.2, 0.15, 0.65]) for l in LABELERS})  # noqa: E741
        for _ in range(rounds):
            soft = [(k, v, n, 1 / (1 + math.exp(-model.odds(k, v)))) for k, v, n in patterns]
            rate = {}
            for i, labeler in enumerate(LABELERS):
                both = []
                for y in (0, 1):
                    mass = [1.0, 1.0, 1.0]
                    for _, v, n, p in soft:
                        mass[v[i] + 1] += n * (p if y else 1 - p)
                    both.append([m / sum(mass) for m in mass])
                rate[labeler] = (both[0], both[1])
            prior = {}
            for kind in model.prior:
                own = [(n, p) for k, _, n, p in soft if k == kind]
                prior[kind] = (sum(n * p for n, p in own) + 1.4) / (sum(n for n, _ in own) + 2)
            model = cls(prior, rate)
        return model

    def odds(self, kind: str, votes: tuple[int, ...]) -> float:
        """Log odds that a span with these votes is personal."""
        out = math.log(self.prior[kind]) - math.log(1 - self.prior[kind])
        for labeler, vote in zip(LABELERS, votes):
            no, yes = self.rate[labeler]
            out += math.log(yes[vote + 1]) - math.log(no[vote + 1])
        return max(-50.0, min(50.0, out))

    def posterior(self, span: Column) -> Column:
        """The same as a probability, of a candidate column."""
        out = F.lit(0.0)
        for kind, p in self.prior.items():
            out = F.when(span["kind"] == kind, math.log(p) - math.log(1 - p)).otherwise(out)
        for labeler in LABELERS:
            vote, (no, yes) = span["votes"][labeler], self.rate[labeler]
            a, b, c = (math.log(y) - math.log(x) for x, y in zip(no, yes))
            out = out + F.when(vote == 1, c).when(vote == 0, b).otherwise(a)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), out))))


@dataclass
class Classifier:
    """Logistic weights of a span's kind and features, learned from posteriors."""

    weights: dict[str, list[float]]

    @classmethod
    def fit(cls, rows: list[tuple[str, tuple[int, ...], float, float]], steps: int = 400, decay: float = 1e-3) -> "Classifier":
        """From rows (kind, features, spans, sum of their posteriors), one for each
        combination that occurs: a bounded number, whatever the table."""
        kinds = [*BASE, *ADDED]
        sizes = [len(kinds), *FEATURES.values()]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        w = np.zeros(starts[-1])
        if rows:
            at = np.array([[kinds.index(k), *f] for k, f, _, _ in rows]) + starts[:-1]
            n, p = np.array([r[2] for r in rows], dtype=float), np.array([r[3] for r in rows])
            m, v = np.zeros_like(w), np.zeros_like(w)
            for step in range(1, steps + 1):
                got = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30)))
                slope = np.bincount(at.ravel(), np.repeat(p - n * got, at.shape[1]), len(w)) / n.sum() - decay * w
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        parts = np.split(w, starts[1:-1])
        return cls({name: x.tolist() for name, x in zip(("kind", *FEATURES), parts)})

    def probability(self, span: Column) -> Column:
        pull = F.element_at(F.array(*[F.lit(x) for x in self.weights["kind"]]), span["order"] + 1)
        for name in FEATURES:
            pull = pull + F.element_at(F.array(*[F.lit(x) for x in self.weights[name]]), span["features"][name] + 1)
        return 1 / (1 + F.exp(-pull))


def _clear(spans: Column) -> Column:
    """Base spans, and the others that no base span overlaps, by kind and start.

    By start, a span is clear if all base spans before it have ended and the
    next one has not begun.
    """
    last = 2**31 - 1

    def kept(events: Column) -> Column:
        ended = scan(F.transform(events, lambda e: F.when(e["added"], 0).otherwise(e["span"]["end"])), 0, lambda a, b: F.greatest(a, b))
        begun = F.reverse(scan(F.reverse(F.transform(events, lambda e: F.when(e["added"], last).otherwise(e["start"]))), last, lambda a, b: F.least(a, b)))
        each = F.arrays_zip(events.alias("e"), ended.alias("ended"), begun.alias("begun"))
        clear = F.filter(each, lambda x: ~x["e"]["added"] | ((x["ended"] <= x["e"]["start"]) & (x["begun"] >= x["e"]["span"]["end"])))
        return F.array_sort(F.transform(clear, lambda x: x["e"]["span"]))

    events = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("added"), s.alias("span"))))
    return F.when(F.exists(spans, lambda s: ~s["base"]) & F.exists(spans, lambda s: s["base"]), _bound(events, kept)).otherwise(spans)


def find_pii(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in every text.

    Returns ``doc_id`` and ``spans``, an array of (order, kind, start, end,
    base, probability), in code points with exclusive ends, by kind and then
    start; and the columns named in ``carry``.

    Spans of the base kinds follow from their patterns and stay. The other kinds'
    candidates, proposed by patterns, a gazetteer of names or context words, are
    kept where the span classifier finds them likelier than not and no base span
    overlaps them. Five labelers (strict pattern, gazetteer, context words,
    isolation, variety of symbols) vote on every candidate of all kinds in the
    whole table; expectation-maximisation over the counts of vote patterns gives
    their reliabilities, and the posteriors train the classifier, which sees the
    span's kind, length, digits, marks, neighbours and the word before it.

    The texts are scanned once; what is found is written to the shared folder. A
    null text has no spans; a null id stays null; repeated rows give repeated
    results; an empty table gives an empty result. Texts are taken whole however
    long; time and memory are in proportion to a text's length and its spans.
    """
    tune(docs.sparkSession)
    scanned = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(whole_text()).alias("found"), *[F.col(c).alias(f"carried_{c}") for c in carry]), "candidates")
    each = scanned.select(F.explode("found").alias("s"))
    counts = each.groupBy("s.kind", *[f"s.votes.{l}" for l in LABELERS]).count()  # noqa: E741
    labels = Reliability.fit(sorted((r[0], tuple(r[1:-1]), r[-1]) for r in counts.collect()))  # a row a vote pattern
    seen = each.groupBy("s.kind", *[f"s.features.{f}" for f in FEATURES]).agg(F.count("*").alias("n"), F.sum(F.round(labels.posterior(F.col("s")), 9).cast("decimal(20,9)")).cast("double").alias("p"))
    model = Classifier.fit(sorted((r[0], tuple(r[1:-2]), float(r[-2]), r[-1]) for r in seen.collect()))  # a row a combination of features
    scored = F.transform(
        "found",
        lambda s: F.struct(s["order"].alias("order"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["order"] < len(BASE)).alias("base"), model.probability(s).alias("probability")),
    )
    sure = F.filter(scored, lambda s: s["base"] | (s["probability"] >= 0.5))
    return scanned.select("doc_id", _bound(sure, _clear).alias("spans"), *[F.col(f"carried_{c}").alias(c) for c in carry])


def digest(found: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), *[count(k) for k in ADDED],
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that
    overlap, what the earlier one leaves of a later one is removed.

    A null text stays null, and a text without spans stays as it is. The text is
    cut into blocks once, and each piece is taken from its blocks.
    """

    def cut(blocks: Column, low: Column, high: Column) -> Column:
        first, last = (low / BLOCK).cast("int"), (high / BLOCK).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        within = F.substring(block(first), low % BLOCK + 1, high - low)
        across = F.concat(F.substring(block(first), low % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), high % BLOCK))
        return F.when(low >= high, "").when(first == last, within).otherwise(across)

    def joined(both: Column) -> Column:
        blocks, ordered = both["blocks"], both["spans"]
        ended = scan(F.transform(ordered, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(ordered, ended, lambda s, at: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(blocks, F.array_max(F.transform(ordered, lambda s: s["end"])), both["length"]))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    both = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), ordered.alias("spans"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, _bound(both, joined)).otherwise(text)
