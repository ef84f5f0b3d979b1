"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived: literals that every match must
hold, as an AND of ORs of strings whose trigrams all have to occur. The index has a posting
(trigram, document) for every trigram that some rule asks for. Postings are intersected per
document, candidates are verified by running the pattern over the whole text, and rules without
mandatory trigrams run over every text.

Documents are posted under a hash of their id and text; should two share it, one is verified
without need, nothing more.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match whose `group` is shorter than `least` is passed over."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The first three kinds are fixed; the others follow published token formats.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, any_case=True,
    ),
    # A run shorter than asked for holds no other match, so the lengths stand in the patterns.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~!$&+-]{3,64}@"),
)
BASE = ("assign", "access", "hex")
#: A set of literals larger than this is not followed further.
_MOST = 64


def literals(pattern: str) -> list[list[str]]:
    """Small-letter strings of three characters or more: one of each list is in every match."""
    found: list[list[str]] = []

    def closed(texts: set[str]) -> set[str]:
        if min(map(len, texts)) >= 3:
            found.append(sorted(texts))
        return {""}

    def choices(op, value) -> set[str] | None:
        """The texts that an element stands for, if they are few."""
        if op is sre.LITERAL:
            return {chr(value).lower()}
        if op is sre.IN:
            out: set[str] = set()
            for kind, x in value:
                if kind is sre.LITERAL:
                    out.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 4:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= 5 else None
        if op is sre.SUBPATTERN:
            return sequence(value[-1])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if op is sre.MAX_REPEAT and value[1] == 1:
            inner = sequence(value[2])
            return None if inner is None else inner | {""} if value[0] == 0 else inner
        return None

    def sequence(items) -> set[str] | None:
        texts = {""}
        for op, value in items:
            own = choices(op, value)
            if own is None or len(texts) * len(own) > _MOST:
                return None
            texts = {a + b for a in texts for b in own}
        return texts

    texts = {""}
    for op, value in sre_parser.parse(pattern):
        own = choices(op, value)
        if own is None:
            texts = closed(texts)
            if op is sre.MAX_REPEAT and value[0] == 1 and (one := sequence(value[2])):
                texts = closed(one)
        elif len(texts) * len(own) > _MOST:
            texts = closed(texts)
            texts = own
        else:
            texts = {a + b for a in texts for b in own}
    closed(texts)
    return found


def trigrams_of(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def wanted_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for any_ in literals(r.pattern) for s in any_ for t in trigrams_of(s)})


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings (trigram, key) of the given small-letter trigrams."""
    lowered = docs.select(document_key().alias("key"), F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return lowered.select("key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and the kinds (an array) whose trigram query the key's postings satisfy."""
    trigrams = wanted_trigrams(rules)
    place = {t: (i // 60, i % 60) for i, t in enumerate(trigrams)}
    n = len(trigrams) // 60 + 1
    numbered = F.map_from_arrays(
        F.array(*map(F.lit, trigrams)), F.array(*[F.lit(i) for i in range(len(trigrams))])
    ) if trigrams else F.create_map()
    bits = postings.withColumn("i", F.element_at(numbered, F.col("trigram"))).select(
        "key",
        *[
            F.when(F.floor(F.col("i") / 60) == m, F.expr("shiftleft(1L, i % 60)")).otherwise(F.lit(0)).cast("long").alias(f"m{m}")
            for m in range(n)
        ],
    )
    met = bits.groupBy("key").agg(*[F.bit_or(f"m{m}").alias(f"m{m}") for m in range(n)])

    def has(text: str) -> Column:
        masks = [0] * n
        for t in trigrams_of(text):
            masks[place[t][0]] |= 1 << place[t][1]
        tests = [F.col(f"m{m}").bitwiseAND(F.lit(x)) == F.lit(x) for m, x in enumerate(masks) if x]
        return _all(tests, True)

    queries = [
        F.when(_all([_all([has(s) for s in any_], False) for any_ in needs], True), F.lit(r.kind))
        for r in rules
        if (needs := literals(r.pattern))
    ]
    kinds = F.array_compact(F.array(*queries)) if queries else F.array().cast("array<string>")
    return met.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _all(tests: list[Column], both: bool) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t if both else out | t
    return out


def _spans(hit: Column) -> Column:
    """start, place, end of a rule's matches, from what lies between them and their own lengths."""
    parts = F.transform(
        hit["found"],
        lambda m, i: F.struct(
            F.length(F.get(hit["between"], i)).alias("gap"), F.length(m).alias("n"),
            F.length(F.get(hit["kept"], i)).alias("kept"),
        ),
    )
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kept:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"),
                    x["kept"].alias("kept"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(
        F.filter(placed, lambda s: s["kept"] >= hit["least"]),
        lambda s: F.struct(s["start"].alias("start"), hit["place"].alias("place"), s["end"].alias("end")),
    )


def secrets(docs: DataFrame, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns in `keep` (all) of every row with secret_spans.

    secret_spans is an array of (start, place of the kind among the rules, end) in code points,
    end exclusive, ascending. Matches of one kind are leftmost and do not overlap; kinds may.
    Null texts count as empty and have no spans. Rows with equal ids or texts are scanned one
    by one; null ids are kept. A column secret_spans of the input is replaced.
    """
    keep = [c for c in (keep or docs.columns) if c != "secret_spans"]
    postings = trigram_index(docs, wanted_trigrams(rules))
    met = candidates(postings, rules).withColumnRenamed("key", "__key").withColumnRenamed("kinds", "__kinds")
    rows = (
        docs.select(*dict.fromkeys([*keep, "doc_id", "text"]), document_key().alias("__key"))
        .join(met, "__key", "left")
        .withColumn("__text", F.coalesce("text", F.lit("")))
    )
    none = F.array().cast("array<string>")
    found, hits = {}, []
    for i, r in enumerate(rules):
        test = F.array_contains("__kinds", r.kind) if literals(r.pattern) else F.lit(True)
        found[f"__found{i}"] = F.when(test, F.regexp_extract_all("__text", F.lit(r.java), F.lit(0))).otherwise(none)
        some, matches = F.size(f"__found{i}") > 0, F.col(f"__found{i}")
        kept = F.when(some, F.regexp_extract_all("__text", F.lit(r.java), F.lit(r.group))).otherwise(none)
        hits.append(
            F.struct(
                F.lit(i).alias("place"), F.lit(r.least).alias("least"), matches.alias("found"),
                (kept if r.group else matches).alias("kept"),
                F.when(some, F.split("__text", r.java, -1)).otherwise(none).alias("between"),
            )
        )
    return (
        rows.withColumns(found)
        .withColumn("__hits", F.filter(F.array(*hits), lambda h: F.size(h["found"]) > 0))
        .select(*keep, F.array_sort(F.flatten(F.transform("__hits", _spans))).alias("secret_spans"))
    )


def written_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"], s["end"])), ","
    )
