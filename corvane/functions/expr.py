"""Column expressions that the operators are made of. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = "array<struct<stage:string,score:double>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# vectors


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 for vectors of unequal or no length and for zero vectors.

    Norms that are already stored may be given.
    """
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(fine, dot(a, b) / (na * nb)).otherwise(0.0)


def narrow(a: Column | str) -> Column:
    """Doubles as floats."""
    return _col(a).cast("array<float>")


def vector_literal(a: Column | str) -> Column:
    """``[1,2.5,3]``, which is JSON; null gives ``[]``."""
    return F.coalesce(F.to_json(_col(a)), F.lit("[]"))


def vector_from(text: Column | str) -> Column:
    """The vector in a JSON text; null where it is not one."""
    return F.from_json(text, "array<float>")


# text


#: Unicode white space.
BLANKS = r"(?U)\s+"


def tokens(text: Column | str) -> Column:
    """Lower-case words between Unicode white space."""
    return F.filter(F.split(F.lower(text), BLANKS), lambda t: t != "")


def marked_tokens(text: Column | str) -> Column:
    """Lower-case words; every punctuation mark or symbol is one of its own."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)[\p{P}\p{S}]|[^\s\p{P}\p{S}]+"), F.lit(0)), lambda t: F.lower(t))


def token_count(text: Column | str) -> Column:
    return F.size(marked_tokens(text))


def approximate_count(text: Column | str) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def sentences(text: Column | str) -> Column:
    """Sentences with what ends them: ``.``, ``!`` or ``?`` and a space or line feed."""
    return F.filter(F.split(text, r"(?<=[.!?][ \n])"), lambda s: s != "")


def valid_text(data: Column | str) -> Column:
    """Bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(_col(data).cast("string"))


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of the content, as 32 bytes."""
    return F.unhex(F.sha2(_col(text).cast("binary"), 256))


def parse_score(text: Column | str) -> Column:
    """The first unsigned number in a text, else 0."""
    found = F.regexp_extract(text, r"\d+\.?\d*", 0)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))


def matches_wildcard(pattern: Column | str, value: Column | str) -> Column:
    """``*`` as the whole pattern matches everything."""
    return (_col(pattern) == "*") | (_col(pattern) == _col(value))


def judge_prompt(kind: str, question: Column, context: Column, answer: Column) -> Column:
    """What a judge is asked about an answer."""
    if kind == "faithfulness":
        return F.format_string("Rate from 0 to 1 how far the context supports the answer.\nContext:\n%s\n\nAnswer:\n%s\n\nScore:", context, answer)
    if kind == "relevance":
        return F.format_string("Rate from 0 to 1 how well the answer responds to the question.\nQuestion:\n%s\n\nAnswer:\n%s\n\nScore:", question, answer)
    raise ValueError(kind)


# units


def as_text(text: Column | str = "text", window: Column | str = "window_text", prefix: Column | str = "context_prefix") -> Column:
    """A chunk's text: its window, or its prefix and text, or its text."""
    w, p = _col(window), _col(prefix)
    return F.when(F.coalesce(w, F.lit("")) != "", w).when(F.coalesce(p, F.lit("")) != "", F.concat(p, F.lit(" "), _col(text))).otherwise(_col(text))


def fact_text(subject: Column | str = "subject", predicate: Column | str = "predicate", object_: Column | str = "object") -> Column:
    return F.format_string("%s is related to %s via %s.", _col(subject), _col(object_), _col(predicate))


def row_text(columns: Column | str) -> Column:
    """``[row] k: v, k: v`` from a map of strings, by key."""
    pairs = F.transform(F.array_sort(F.map_entries(columns)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("<nil>"))))
    return F.concat(F.lit("[row] "), F.array_join(pairs, ", "))


def with_score(scores: Column | str, stage: str, score: Column) -> Column:
    """Provenance with one more entry."""
    before = F.coalesce(_col(scores), F.array().cast(SCORES))
    return F.concat(before, F.array(F.struct(F.lit(stage).alias("stage"), score.cast("double").alias("score"))).cast(SCORES))


def last_score(scores: Column | str) -> Column:
    """The score of the last entry, 0 without any."""
    return F.coalesce(F.try_element_at(scores, F.lit(-1))["score"], F.lit(0.0))


# metadata


@dataclass(frozen=True)
class MetadataFilter:
    """A predicate on one metadata field: ``eq``, ``in`` or ``any_of``."""

    field: str
    op: str
    value: Any

    def column(self, columns: Sequence[str] = (), metadata: str = "metadata") -> Column:
        """The predicate, false where the field is missing.

        A field that is a column of its own is compared there, so that the scan
        can skip rows; others are read from the variant column ``metadata``.
        Values compare as strings. A list never equals a scalar, an unknown
        operator matches nothing.
        """
        own = self.field in columns
        many = isinstance(self.value, (list, tuple, set))
        path = f"$.{self.field}"
        if self.op == "eq" and not many:
            value = str(self.value).lower() if isinstance(self.value, bool) else str(self.value)
            test = (F.col(self.field).cast("string") if own else F.try_variant_get(metadata, path, "string")) == value
        elif self.op == "in" and many:
            test = (F.col(self.field).cast("string") if own else F.try_variant_get(metadata, path, "string")).isin([str(v) for v in self.value])
        elif self.op == "any_of" and many:
            field = F.col(self.field).cast("array<string>") if own else F.try_variant_get(metadata, path, "array<string>")
            test = F.arrays_overlap(field, F.array(*[F.lit(str(v)) for v in self.value]).cast("array<string>"))
        else:
            return F.lit(False)
        return F.coalesce(test, F.lit(False))


def match_all(filters: Sequence[MetadataFilter], columns: Sequence[str] = (), metadata: str = "metadata") -> Column:
    """All of them; no filter at all is true."""
    return reduce(and_, (f.column(columns, metadata) for f in filters), F.lit(True))


def with_key(metadata: Column | str, key: str, value: str) -> Column:
    """A variant object with one key set to a JSON value, whatever it was."""
    held = F.coalesce(_col(metadata).cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(held, lambda k, v: k != key)
    return F.parse_json(F.to_json(F.map_concat(others, F.create_map(F.lit(key), F.parse_json(F.lit(value))))))
