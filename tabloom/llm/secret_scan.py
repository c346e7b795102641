"""Secret scans by a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression.  The strings that a match must contain are read off its parsed form:
runs of literals, sets and short alternatives that can be written out.  Each run becomes a Boolean query
over lower-case trigrams, an OR of ANDs.  The index holds, for the trigrams that any query names, the
documents containing them; a query intersects its trigrams' postings, and only its candidates are
verified with the regular expression.  A rule without such strings (hexadecimal runs) scans every text.

One pass over the texts builds the postings (one lookahead expression finds all indexed trigrams); they
are grouped by document, never by trigram, so a frequent trigram is no hot key.  Verification reads the
texts again and joins the candidates, which are broadcast while they are few and shuffled beyond.

Matches are leftmost and do not overlap within a rule; those that are too short are dropped after
matching.  Offsets count code points, the end is exclusive.

Edge cases: a null text counts as empty and has no spans; rows that repeat are candidates together and
each gives a row; null document ids are ordinary; an empty table gives an empty result.  Other columns
are not read by ``scan_secrets``; ``redact_secrets`` hands them on, and keeps its own columns apart by
names that no input column has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import all_columns, cut_lineage, lower_az

#: Candidates are broadcast up to this many documents (about 40 bytes each), else joined by a shuffle.
BROADCAST_CANDIDATES = 200_000
MAX_STRINGS = 64
PLACEHOLDER = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """``group`` of every match must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The rules, in the order in which spans at the same place are listed.
BASE_RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
PROVIDER_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + PROVIDER_RULES


def _strings(node) -> list[str] | None:
    """All strings that a parsed part can match, or None if they can't be written out."""
    op, value = node
    if op is C.LITERAL:
        return [chr(value).lower()]
    if op is C.IN:
        chars = set()
        for kind, item in value:
            if kind is C.LITERAL:
                chars.add(chr(item).lower())
            elif kind is C.RANGE and item[1] - item[0] < 4:
                chars.update(chr(c).lower() for c in range(item[0], item[1] + 1))
            else:
                return None
        return sorted(chars) if len(chars) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(value[-1])
    if op is C.BRANCH:
        options = [_sequence_strings(branch) for branch in value[1]]
        return None if None in options else sorted({s for o in options for s in o})
    if op is C.MAX_REPEAT and value[1] is not C.MAXREPEAT and value[1] <= 5:
        inner = _sequence_strings(value[2])
        if inner is None:
            return None
        out, power = set(), {""}
        for times in range(value[1] + 1):
            out |= power if times >= value[0] else set()
            power = {a + b for a in power for b in inner}
            if len(power) > MAX_STRINGS:
                return None
        return sorted(out)
    return None


def _sequence_strings(nodes) -> list[str] | None:
    made = [""]
    for node in nodes:
        options = _strings(node)
        if options is None or len(made) * len(options) > MAX_STRINGS:
            return None
        made = [a + b for a in made for b in options]
    return made


def _trigrams(string: str) -> frozenset[str]:
    return frozenset(string[i : i + 3] for i in range(len(string) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of trigrams that every match contains in lower case; empty: the rule must scan fully.

    Of the runs of a pattern the one whose weakest alternative has most trigrams is taken.
    """
    runs, run = [], [""]
    for node in _parser.parse(pattern):
        options = _strings(node)
        if options is None or len(run) * len(options) > MAX_STRINGS:
            runs.append(run)
            run = [""] if options is None else options
        else:
            run = [a + b for a in run for b in options]
    best = max([*runs, run], key=lambda r: min(len(_trigrams(s)) for s in r))
    clauses = {_trigrams(s) for s in best}
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _any_of(trigrams: list[str]) -> str:
    """One lookahead expression that captures whichever of the trigrams starts at a place."""
    by_first: dict[str, dict[str, list[str]]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    esc = re.escape
    heads = ["%s(?:%s)" % (esc(a), "|".join("%s[%s]" % (esc(b), "".join(esc(c) for c in cs)) for b, cs in by.items())) for a, by in by_first.items()]
    return "(?=(" + "|".join(heads) + "))"


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc): the inverted index over the given trigrams; ``docs`` has ``doc`` and ``text``."""
    found = F.array_distinct(F.regexp_extract_all(lower_az(F.col("text")), F.lit(_any_of(trigrams)), F.lit(1)))
    return docs.select("doc", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc, rules): the numbers of the rules whose Boolean query holds for a document."""
    clauses = [(r, c, t, len(clause)) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern)) for t in sorted(clause)]
    if not clauses:
        return docs.select("doc").limit(0).withColumn("rules", F.array().cast("array<int>"))
    index = postings(docs, sorted({t for _, _, t, _ in clauses}))
    wanted = docs.sparkSession.createDataFrame(clauses, "rule int, clause int, wanted string, need int")
    hits = index.join(F.broadcast(wanted), F.col("trigram") == F.col("wanted"))  # one row per trigram of a rule
    met = hits.groupBy("doc", "rule", "clause", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    return met.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _rule_spans(rule: Rule, number: int, text: Column) -> Column:
    """Array of (start, kind, end) of one rule's matches; the parts between matches give the offsets."""
    pattern = F.lit(rule.pattern)
    parts = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else F.transform(matches, lambda m: m)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["part"])
        end = begin + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        found = F.when(F.length(x["checked"]) >= F.lit(max(1, rule.least)), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    zipped = F.arrays_zip(parts.alias("part"), matches.alias("whole"), checked.alias("checked"))
    return F.aggregate(zipped, start, step, lambda acc: acc["found"])


def _spans(text: Column, rules, allowed: Column) -> Column:
    """All spans by start, then kind; a rule runs where it is a candidate, a rule without query where a long run stands."""
    none = F.array().cast(_SPAN)
    each = []
    for number, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            hit = F.array_contains(allowed, F.lit(number))
        else:
            hit = text.rlike(rule.pattern[:-1] + "{%d}" % rule.least) if rule.least and rule.pattern.endswith("]+") else F.lit(True)
        each.append(F.when(hit, _rule_spans(rule, number, text)).otherwise(none))
    return F.array_sort(F.concat(*each))


def _marked(docs: DataFrame, rules, doc_id: str, text: str, key: str, allowed: str) -> DataFrame:
    """``docs`` with the columns ``key`` and ``allowed`` (numbers of its candidate rules, null if none)."""
    narrow = docs.select(_key(F.col(doc_id), F.col(text)).alias("doc"), F.col(text).alias("text"))
    found = candidates(narrow, rules).select(F.col("doc").alias(f"{key}_found"), F.col("rules").alias(allowed))
    found = cut_lineage(found)
    if found.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES:
        found = F.broadcast(found)
    keyed = docs.withColumn(key, _key(F.col(doc_id), F.col(text)))
    return keyed.join(found, F.col(key) == F.col(f"{key}_found"), "left").drop(f"{key}_found")


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while any(t.startswith(name) for t in taken):
        name += "_"
    return name


def scan_secrets(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): the spans are (start, kind as the rule's number, end) by start, then kind."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = _marked(narrow, rules, "doc_id", "text", "scan_key", "scan_rules")
    return marked.select("doc_id", _spans(F.col("text"), rules, F.col("scan_rules")).alias("spans"))


def spans_text(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """All rows and columns of ``docs``; spans in ``text`` are replaced, overlapping ones by one placeholder."""
    key, spans = _free_name(docs, "scan_key"), _free_name(docs, "scan_spans")
    marked = _marked(docs, rules, doc_id, text, key, f"{key}_rules")
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = marked.withColumn(spans, _spans(whole, rules, F.col(f"{key}_rules")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        lead = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(placeholder))
        out = F.when(s["start"] >= acc["at"], lead).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    clean = F.when(F.size(spans) > 0, done).otherwise(F.col(text))
    return marked.withColumn(text, clean).select(*all_columns(docs))
