"""Personal data by weak supervision.

Base spans come from fixed patterns and checks and always stay. Looser
patterns give more candidates. Labelers (format, gazetteer, words before, edges,
variety) vote on every candidate; the gazetteers are short lists and what the
corpus itself shows (domains of addresses, names after titles). Expectation-
maximisation over the counts of vote patterns estimates how reliable each
labeler is and gives each pattern a posterior. A logistic classifier of each kind
is trained on these soft labels, from a bounded sample. It doesn't see the votes
but the span itself and its context: length, share of digits, shape, beginning,
the characters beside it and the word before. It decides which loose candidates
become spans.

Only DataFrame functions touch the documents. A match's place is the length of
what ``split`` leaves before it and of the matches before it. What reaches the
driver is one row per vote pattern (KINDS x 3^5 at most) and the sample (SAMPLE
different candidates of each kind, about, however often each occurs).

The patterns are written so that Java's matcher neither backtracks over a run
nor starts anew inside one; they find the same spans as the plain forms in the
comments. A place is counted in code points, ends are exclusive.

Defined results: a null text counts as empty; such a document has no span, zero
counts and the digest of the empty string; a very long text is searched whole,
and a match may be of any length; rows are kept apart even when ids repeat or
are null; other columns are never looked at, so their names don't matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.rows import if_few, narrow
from siltstone.llm.toxicity import logistic
from siltstone.scratch import written

#: In the order of ties. [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+;
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+); [0-9]([\x20-]?[0-9])+, of which single
#: digits fall to the digit count; \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "loose_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]++)++",
    "loose_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key) ?[=:] ?[\"']?[a-z0-9_/+-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:[Nn]ame is|[Nn]amed|Mr\.?|Mrs\.?|Ms\.?|Dr\.?) \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?(?!\p{L})",
}
#: A text that doesn't contain these has no match of the pattern either.
TRIGGER = {"email": "@", "phone": "+"}
#: The same for loose_email, whose letters may be of either case: a part that each match holds.
BRACKETED_AT = r"(?i)[\[(] ?at ?[\])]"
KINDS = [*BASE, "secret", "ssn", "iban", "name"]
SHOWN = {"loose_email": "email", "loose_phone": "phone"}
LABELERS = ("format", "gazetteer", "before", "edges", "variety")
BEFORE = 40
#: Different candidates of each kind that the classifier is trained on, about: those of least hash.
SAMPLE = 2000
#: Matches that make a domain or a name one of the gazetteer.
SEEN = 5
#: The classifier's features and their numbers of values; hashed ones have HASHED, and one for nothing.
HASHED = 64
FEATURES = {"f_length": 8, "f_digits": 4, "f_left": 4, "f_right": 4, "f_word": HASHED + 1, "f_begin": HASHED + 1, "f_shape": HASHED + 1}

GIVEN_NAMES = "james john robert michael william david mary patricia linda elizabeth anna maria jose juan carlos luis hans peter klaus jean pierre marie sophie paul thomas laura julia emma lucas".split()
MAIL_DOMAINS = "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com gmx.de web.de orange.fr free.fr example.com example.org example.net".split()
CUES = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|login|adresse",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|\btel|call|mobile|fax|sms|whatsapp|anruf|appel|llam",
    "secret": "auth|key|token|secret|password|login|export|config",
    "ssn": r"social|\bssn|tax|insurance",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "name": "my|i am|signed|regards|patient|customer|dear",
}
COUNTER_CUES = r"version|release|order|invoice|isbn|issn|ticket|build|section|chapter|page|serial|model"


def shown(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))
    return F.coalesce(F.try_element_at(names, kind), kind)


def luhn(digits: Column) -> Column:
    """Whether the digit string passes, for up to 19 digits."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d.cast("int"))),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(parts, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255")))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """All documents (row, key), and the matches of all patterns in them.

    A match: row, kind, start, end, match, before, after. The text is read once.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    patterns = BASE | LOOSE

    def found(name: str, x: Column) -> Column:
        p = F.lit(patterns[name])
        left = F.split(x, patterns[name], -1)
        zipped = F.arrays_zip(
            F.transform(left, lambda s: F.struct(F.length(s).alias("skip"), F.right(s, F.lit(BEFORE)).alias("before"), F.left(s, F.lit(1)).alias("first"))).alias("left"),
            F.regexp_extract_all(x, p, F.lit(0)).alias("match"),
        )
        may_match = x.rlike(BRACKETED_AT) if name == "loose_email" else F.contains(x, F.lit(TRIGGER[name])) if name in TRIGGER else F.lit(True)
        # the last entry has no match; it is needed only for what follows the last but one
        return F.when(may_match, F.when(F.size(left) > 1, zipped))

    bare = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), whole.alias("x"))
    seen = written(bare.select("row", "key", *(found(name, F.col("x")).alias(name) for name in patterns)), "matches")
    kinds = F.array(*(F.struct(F.lit(name).alias("kind"), F.col(name).alias("parts")) for name in patterns))
    parts = (
        seen.filter(" OR ".join(f"{name} IS NOT NULL" for name in patterns))
        .select("row", F.explode(kinds).alias("k"))
        .select("row", "k.kind", F.posexplode("k.parts").alias("at", "part"))
    )
    run = Window.partitionBy("row", "kind").orderBy("at")
    placed = parts.select(
        "row",
        "kind",
        (
            F.sum(F.col("part.left.skip")).over(run)
            + F.coalesce(F.sum(F.length("part.match")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("start"),
        F.col("part.match").alias("match"),
        F.col("part.left.before").alias("before"),
        F.coalesce(F.lead("part.left.first").over(run), F.lit("")).alias("after"),
    ).filter("match IS NOT NULL")
    return seen.select("row", "key"), placed.withColumn("end", F.col("start") + F.length("match"))


def listed(kind: Column, match: Column) -> Column:
    """What a gazetteer lists of a match: an address's domain, a name's last word; null for other kinds."""
    dotted = F.regexp_replace(F.lower(match), r" ?[\[(] ?dot ?[\])] ?", ".")
    domain = F.regexp_replace(dotted, r"^.*(?:@|[\])] ?)", "")
    return F.when(shown(kind) == "email", domain).when(kind == "name", F.regexp_extract(F.lower(match), r"(\p{L}+)$", 1))


def with_gazetteer(spans: DataFrame) -> DataFrame:
    """``spans`` with is_listed: whether what a gazetteer would list is in SEEN base addresses or names."""
    named = spans.withColumns({"_kind": shown(F.col("kind")), "_listed": listed(F.col("kind"), F.col("match"))})
    sure = named.filter("_listed IS NOT NULL AND (base OR kind = 'name')")
    seen = written(narrow(sure.groupBy(F.col("_kind").alias("k"), F.col("_listed").alias("l")).count().filter(F.col("count") >= SEEN).select("k", "l")), "gazetteer")
    joined = named.join(if_few(seen), (F.col("_kind") == F.col("k")) & (F.col("_listed") == F.col("l")), "left")
    return joined.select(*spans.columns, F.col("l").isNotNull().alias("is_listed"))


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(spans: DataFrame) -> DataFrame:
    """The labelers' votes on ``spans`` with is_listed: 1 personal, -1 not, 0 none."""
    kind, match, before, after = (F.col(c) for c in ("kind", "match", "before", "after"))
    plain = shown(kind)
    lower, digits = F.lower(match), F.regexp_replace(match, "[^0-9]", "")
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(plain == k, F.lower(before).rlike(f"(?:{words})[^.]{{0,24}}$")).otherwise(cue)
    is_base = kind.isin(*BASE)
    names = F.array(*map(F.lit, GIVEN_NAMES))
    in_gazetteer = (
        F.when(plain == "email", F.col("is_listed") | listed(kind, match).rlike("(?:^|\\.)(?:" + "|".join(d.replace(".", r"\.") for d in MAIL_DOMAINS) + ")$"))
        .when(kind == "card", digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"))
        .when(plain == "phone", digits.rlike("^(?:1[2-9]|[2-9])"))
        .when(kind == "secret", lower.rlike("[0-9]") & lower.rlike("[a-z][^a-z]*$"))
        .when(kind == "ssn", ~match.rlike("^(?:000|666|9)"))
        .when(kind == "iban", match.rlike("^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|PL)"))
        .when(kind == "name", F.col("is_listed") | F.exists(F.split(lower, "[ .]+"), lambda w: F.array_contains(names, w)))
        .otherwise(False)
    )
    not_in_gazetteer = F.when(kind == "ip", match.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\.")).when(kind.isin("card", "ssn", "name"), ~in_gazetteer).otherwise(False)
    edge = F.right(before, F.lit(1))
    varied = F.size(F.array_distinct(F.split(F.when(F.length(digits) > 0, digits).otherwise(lower), "")))
    return spans.withColumns({
        "format": vote(F.when(is_base, F.col("base")).otherwise(True), is_base & ~F.col("base")),
        "gazetteer": vote(in_gazetteer, not_in_gazetteer),
        "before": vote(cue, F.lower(before).rlike(f"(?:{COUNTER_CUES})[^.]{{0,12}}$")),
        "edges": vote(edge.rlike(r"^(?:|[\s\"'(<\[:,;=])$"), edge.rlike(r"[\p{L}0-9]") | after.rlike(r"^[\p{L}0-9]")),
        "variety": vote(varied >= 4, varied <= 2),
    })


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[dict[int, list[float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns and how often each occurs.

    Returns the prior, each labeler's P(vote | class) as {vote: [not, is]}, and
    each pattern's posterior. Starts from the majority vote.
    """
    post = {p: 1 / (1 + math.exp(-sum(p))) for p in patterns}
    prior, given = 0.5, []
    for _ in range(rounds):
        total = sum(patterns.values())
        mass = sum(post[p] * n for p, n in patterns.items())
        prior = (mass + 1) / (total + 2)
        given = []
        for k in range(len(LABELERS)):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, n in patterns.items():
                seen[p[k]][0] += (1 - post[p]) * n
                seen[p[k]][1] += post[p] * n
            sums = [sum(x[c] for x in seen.values()) for c in (0, 1)]
            given.append({v: [x[0] / sums[0], x[1] / sums[1]] for v, x in seen.items()})
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(given[k][v][1] / given[k][v][0]) for k, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, given, post


def features(spans: DataFrame) -> DataFrame:
    """``spans`` with the columns of FEATURES, numbers from 0."""
    match, before, after = (F.col(c) for c in ("match", "before", "after"))
    size = F.length(match)
    side = lambda x: F.when(x == "", 0).when(x.rlike(r"[\p{L}\p{N}]"), 1).when(x.rlike(r"\s"), 2).otherwise(3)
    hashed = lambda x: F.when(x == "", HASHED).otherwise(F.pmod(F.xxhash64(x), F.lit(HASHED)))
    # a letter or digit for each run of them, as far as a shape tells something
    shape = F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(match, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9"), F.lit(12))
    return spans.withColumns({
        "f_length": F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(7)),
        "f_digits": F.floor(F.length(F.regexp_replace(match, "[^0-9]", "")) * 3.99 / F.greatest(size, F.lit(1))),
        "f_left": side(F.right(before, F.lit(1))),
        "f_right": side(after),
        "f_word": hashed(F.regexp_extract(F.lower(before), r"(\p{L}+)\P{L}*$", 1)),
        "f_begin": hashed(F.lower(F.left(match, F.lit(3)))),
        "f_shape": hashed(shape),
    })


def train(rows: list[tuple[str, tuple[int, ...], float]]) -> dict[str, np.ndarray]:
    """(kind, values of FEATURES, soft label) to each kind's weights: the bias, then one of each value of each feature."""
    offsets = np.cumsum([0, *FEATURES.values()])
    out = {}
    for kind in sorted({k for k, _, _ in rows}):
        own = [(f, y) for k, f, y in rows if k == kind]
        x = np.zeros((len(own), int(offsets[-1])))
        x[np.arange(len(own))[:, None], np.array([f for f, _ in own]) + offsets[:-1]] = 1
        out[kind] = logistic(x, np.array([y for _, y in own]), decay=0.1)
    return out


def probability(weights: dict[str, np.ndarray]) -> Column:
    """What the classifier of the span's kind says; a half for a kind without one."""
    offsets = np.cumsum([1, *FEATURES.values()])
    z = F.lit(0.0)
    for kind, w in weights.items():
        own = F.lit(float(w[0]))
        for a, b, name in zip(offsets[:-1], offsets[1:], FEATURES, strict=True):
            own = own + F.get(F.lit(w[a:b].tolist()), F.col(name).cast("int"))
        z = F.when(F.col("kind") == kind, own).otherwise(z)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The documents (row, key) and their spans: row, kind, start, end, match, base, score.

    Of the loose candidates one stays that the classifier accepts, that touches
    no base span and that starts after all earlier accepted ones have ended.
    """
    rows, found = candidates(docs, text, key)
    checked = written(found.withColumn("base", valid(F.col("kind"), F.col("match"))), "candidates")
    # by what they are and where, so that neither partitions nor copies matter
    alike = F.xxhash64("kind", "match", "before", "start")
    judged = written(features(votes(with_gazetteer(checked))).withColumn("alike", alike), "votes")
    counted = judged.groupBy("kind", *LABELERS).count().collect()  # one row per vote pattern
    patterns: dict[tuple[int, ...], float] = {}
    for r in counted:
        p = tuple(r[n] for n in LABELERS)
        patterns[p] = patterns.get(p, 0) + r["count"]
    _, _, post = reliabilities(patterns)
    share = F.lit(0.0)
    for r in judged.groupBy("kind").agg(F.approx_count_distinct("alike").alias("n")).collect():
        share = F.when(F.col("kind") == r["kind"], min(1.0, SAMPLE / max(1, r["n"]))).otherwise(share)
    sampled = judged.filter(F.col("alike") / 2.0**64 + 0.5 < share).select("kind", "alike", *LABELERS, *FEATURES).distinct().collect()
    weights = train([(r["kind"], tuple(r[f] for f in FEATURES), post[tuple(r[n] for n in LABELERS)]) for r in sorted(sampled)])
    scored = judged.withColumn("score", probability(weights))
    kept = scored.filter(F.col("base") | (~F.col("kind").isin(*BASE) & (F.col("score") >= threshold)))
    by_start = Window.partitionBy("row").orderBy("start", "end", "kind")
    earlier, later = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    free = F.coalesce(F.col("start") >= F.max("end").over(earlier), F.lit(True)) & F.coalesce(
        F.col("end") <= F.min(F.when(F.col("base"), F.col("start"))).over(later), F.lit(True)
    )
    spans = kept.withColumn("free", free).filter("base OR free")
    return rows, spans.select("row", shown(F.col("kind")).alias("kind"), "start", "end", "match", "base", "score")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans as text."""
    rows, spans = find(docs, text, key)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("shown"))
    per = spans.groupBy("row").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE),
        F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("base"),
        F.sort_array(F.collect_list(item)).alias("all"),
    )
    joined = rows.join(per, "row", "left")
    line = lambda c: F.concat_ws(",", F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["shown"]))
    return joined.select(
        F.col("key").alias(key),
        *(F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.when(F.col("base").isNull(), F.lit("")).otherwise(line("base")), 256).alias("base_sha256"),
        F.when(F.col("all").isNull(), F.lit("")).otherwise(line("all")).alias("spans"),
    )
