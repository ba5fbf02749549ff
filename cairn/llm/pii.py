"""Personal data by weak supervision.

Patterns find candidates. Four kinds are personal data wherever their check passes; others
(credentials, account numbers, local telephone numbers, national ids, names after a title, street addresses) are only candidates. Labelers vote on every candidate, those that
fail their check included: the check itself, gazetteers, the words before it, what stands
around it, how varied its characters are. The votes are counted by pattern over all
candidates; expectation-maximisation on the counts estimates how often each labeler is right
and the probability of each pattern. With these as soft labels a logistic classifier of the
candidate's features is trained, and it decides which further spans are added. The counts have
a bounded number of rows whatever the corpus; all else is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import text_or_empty

#: Kinds in listed order. Possessive repeats and the look-behinds change no match, only keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)['\"]?[\x20\t]{0,8}[:=][\x20\t]{0,8}['\"]?[A-Za-z0-9+/_=.-]{6,}['\"]?",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Se\u00f1or|Se\u00f1ora)\.?(?:\x20\p{Lu}\p{Ll}{1,20}(?:-\p{Lu}\p{Ll}{1,20})?){1,3}\b",
    "address": r"\b[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}{1,20}\x20){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square)\b|\b\p{Lu}\p{Ll}{1,25}(?:stra\u00dfe|strasse|gasse|platz|allee)\x20[0-9]{1,4}\b|\b[0-9]{1,4},?\x20(?:rue|avenue|boulevard)\x20(?:de\x20|du\x20|la\x20){0,2}\p{Lu}\p{Ll}{1,20}\b",
}
KINDS = {**BASE, **FURTHER}
#: A text without this has no match of the kind.
SCREEN = {"email": "@", "ip": ".", "phone": "+", "national_id": "-"}
#: Beginnings of words that announce personal data, in the languages of the corpus (fixed values).
CUES = "e?mail|contact|call|phone|tel|fax|mobil|reach|card|visa|credit|carte|tarjeta|karte|konto|iban|account|server|host|login|user|token|secret|password|key|kontakt|anruf|appel|joindre|correo|llam|write|schreib|address|adresse|adress|direcci|name|nom|nombre|ssn|social|born|lives?|wohn|habite|vive|signed|sincerely"
#: Top-level domains, the first digits of card issuers, country codes (fixed values).
TLDS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|be"
CARD_STARTS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
COUNTRIES = "1|33|34|44|49|39|41|43|31|32|351|48|46|47|45|7|81|86|91|55|52"
#: Common given names, and numbers that are printed as examples (fixed values).
NAMES = "Anna|Maria|Marie|Sophie|Julia|Laura|Emma|Olivia|Sarah|Elizabeth|Susan|Linda|Carmen|Lucia|Isabel|Claire|Camille|Ursula|Monika|Petra|John|James|Robert|Michael|William|David|Thomas|Peter|Paul|Daniel|Hans|Klaus|Stefan|Andreas|Jean|Pierre|Michel|Jacques|Jose|Juan|Carlos|Luis|Antonio|Miguel"
EXAMPLES = "078-05-1120|219-09-9999|123-45-6789"
LABELERS = ("check", "gazetteer", "context", "edges", "variety")
BLOCK = 256


def found(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with `candidates`: per match of any kind its place (code points, end exclusive), check, votes and features."""
    rest = [c for c in df.columns if c not in ("candidates", text)]
    x = F.col("__text")
    out = df.select(*[f"`{c}`" for c in rest], text_or_empty(text).alias("__text"))
    none = F.array().cast("array<string>")
    for k, (kind, pattern) in enumerate(KINDS.items()):
        hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        out = out.withColumn(f"__m{k}", F.when(F.contains(x, F.lit(SCREEN[kind])), hits).otherwise(none) if kind in SCREEN else hits)
    for k, pattern in enumerate(KINDS.values()):
        out = out.withColumn(f"__s{k}", F.when(F.size(f"__m{k}") > 0, F.split(x, pattern, -1)))
    for k in range(len(KINDS)):
        parts = f"transform(`__m{k}`, (m, j) -> named_struct('gap', length(`__s{k}`[j]), 'len', length(m), 'hit', m, 'before', lower(right(`__s{k}`[j], 40)), 'after', left(`__s{k}`[j + 1], 2)))"
        out = out.withColumn(f"__a{k}", F.expr(parts))
    for k in range(len(KINDS)):
        out = out.withColumn(f"__p{k}", F.expr(_starts(f"`__a{k}`")))
    each = [F.expr(f"transform(`__a{k}`, (a, j) -> {_candidate(k, kind)})") for k, kind in enumerate(KINDS)]
    return out.select(*[f"`{c}`" for c in rest], *([x.alias(text)] if keep_text else []), F.concat(*each).alias("candidates"))


def _starts(parts: str) -> str:
    """Running starts of parts (gap, len), in blocks so that appending stays cheap for very many."""
    inner = f"aggregate(slice({parts}, b * {BLOCK} + 1, {BLOCK}), named_struct('pos', st.pos, 'acc', cast(array() AS array<bigint>)), (y, e) -> named_struct('pos', y.pos + e.gap + e.len, 'acc', array_append(y.acc, y.pos + e.gap)))"
    step = f"element_at(transform(array({inner}), y -> named_struct('pos', y.pos, 'acc', array_append(st.acc, y.acc))), 1)"
    return f"flatten(aggregate(sequence(0, (size({parts}) - 1) div {BLOCK}), named_struct('pos', 0L, 'acc', cast(array() AS array<array<bigint>>)), (st, b) -> {step}, st -> st.acc))"


def _candidate(k: int, kind: str) -> str:
    """SQL of a candidate of kind k from its part a; votes are 1, -1 or, for no vote, 0."""
    digits = "regexp_replace(a.hit, '[^0-9]', '')"
    luhn = "aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substring(reverse(d), i, 1)) WHEN int(substring(reverse(d), i, 1)) > 4 THEN 2 * int(substring(reverse(d), i, 1)) - 9 ELSE 2 * int(substring(reverse(d), i, 1)) END) % 10 = 0"
    check = {
        "ip": "forall(split(a.hit, '[.]'), q -> length(ltrim('0', q)) <= 3 AND coalesce(try_cast(ltrim('0', q) AS INT), 0) <= 255)",
        "card": f"exists(array({digits}), d -> CASE WHEN length(d) BETWEEN 12 AND 19 THEN {luhn} ELSE false END)",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }.get(kind, "true")
    known = {
        "email": f"a.hit RLIKE '(?i)[.](?:{TLDS})$'",
        "ip": "NOT a.hit RLIKE '^(?:0|127|255)[.]'",
        "card": f"a.hit RLIKE '^(?:{CARD_STARTS})'",
        "phone": f"a.hit RLIKE '^[+](?:{COUNTRIES})'",
        "secret": "NOT lower(a.hit) RLIKE 'changeme|example|xxxx|placeholder'",
        "iban": "a.hit RLIKE '^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|LU|PT|IE)'",
        "local_phone": "a.hit RLIKE '^[(]?[2-9]'",
        "national_id": f"NOT a.hit RLIKE '^(?:{EXAMPLES})$'",
        "person": f"a.hit RLIKE '[ -](?:{NAMES})(?:[ -]|$)'",
        "address": "a.hit RLIKE '(?:^|[^0-9])[1-9][0-9]{0,4}(?:[^0-9]|$)'",
    }[kind]
    yes = lambda sql: f"CASE WHEN {sql} THEN 1 ELSE -1 END"
    votes = [
        yes(check) if kind in ("ip", "card", "phone") else "0",
        yes(known),
        f"CASE WHEN a.before RLIKE '\\\\b(?:{CUES})[^\\\\n]{{0,24}}$' THEN 1 ELSE 0 END",
        "CASE WHEN a.before RLIKE '[a-z0-9_.-]$' OR a.after RLIKE '^[A-Za-z0-9_]' THEN -1 ELSE 0 END",
        yes(f"size(array_distinct(split(a.hit, ''))) >= {3 if kind == 'ip' else 6}"),
    ]
    features = ["a.len >= 16", "a.len >= 40", "a.before RLIKE '\\\\s$'", "a.hit RLIKE '[A-Za-z]'"]
    return (
        f"named_struct('start', `__p{k}`[j], 'kind', {k}, 'end', `__p{k}`[j] + a.len, 'ok', {check}, "
        f"'votes', array({', '.join(votes)}), 'features', array({', '.join(f'int({f})' for f in features)}))"
    )


def vote_counts(table: DataFrame) -> list:
    """(kind, ok, votes, features, n): at most kinds x 2 x 3^labelers x 2^features rows."""
    each = table.select(F.explode("candidates").alias("c"))
    return each.groupBy("c.kind", "c.ok", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")).collect()


def reliabilities(counts: list, rounds: int = 50) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """By expectation-maximisation: the share of personal data in each kind, and each labeler's rates of right votes on personal data and on the rest."""
    share = {r.kind: 0.7 for r in counts}
    right = [(0.8, 0.8)] * len(LABELERS)
    for _ in range(rounds):
        mass = {k: [1.4, 2.0] for k in share}  # with the prior's pseudo-counts
        hits = [[[8.0, 10.0], [8.0, 10.0]] for _ in LABELERS]
        for r in counts:
            p = posterior(share, right, r.kind, r.votes)
            mass[r.kind][0] += p * r.n
            mass[r.kind][1] += r.n
            for (yes, no), v in zip(hits, r.votes, strict=True):
                if v:
                    yes[0] += r.n * p * (v > 0)
                    yes[1] += r.n * p
                    no[0] += r.n * (1 - p) * (v < 0)
                    no[1] += r.n * (1 - p)
        share = {k: min(0.99, max(0.01, a / b)) for k, (a, b) in mass.items()}
        right = [tuple(min(0.99, max(0.5, a / b)) for a, b in x) for x in hits]
    return share, right


def posterior(share: dict[int, float], right: list[tuple[float, float]], kind: int, votes: list[int]) -> float:
    odds = math.log(share[kind] / (1 - share[kind]))
    for (yes, no), v in zip(right, votes, strict=True):
        odds += math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no) if v < 0 else 0
    return 1 / (1 + math.exp(-max(-30, min(30, odds))))


def inputs(kind: int, votes: list[int], features: list[int]) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *map(float, votes), *map(float, features)]


def classifier(counts: list, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier for inputs(), trained on the soft labels of the counts."""
    share, right = reliabilities(counts)
    width = len(inputs(0, [0] * len(LABELERS), [0] * 4))
    rows = [(inputs(r.kind, r.votes, r.features), posterior(share, right, r.kind, r.votes), r.n) for r in counts]
    total = sum(n for _, _, n in rows)
    w = [0.0] * width
    for _ in range(rounds if rows else 0):
        slope = [decay * v for v in w]
        for x, p, n in rows:
            z = sum(a * b for a, b in zip(w, x, strict=True))
            off = n / total * (1 / (1 + math.exp(-max(-30, min(30, z)))) - p)
            for i, v in enumerate(x):
                slope[i] += off * v
        w = [a - rate * 4 * b for a, b in zip(w, slope, strict=True)]
    return w


def spans(table: DataFrame, candidates: str = "candidates") -> DataFrame:
    """A written table of found() texts with base and spans: arrays of (start, kind, end), by start, then kind as listed.

    base holds every match of the four base kinds that passes its check. spans holds these and the
    further candidates that the classifier takes to be personal data and that overlap none of
    base. Repeated rows get equal spans; a text without candidates has empty ones.
    """
    w = classifier(vote_counts(table))
    n_base = len(BASE)
    by_kind = ", ".join(f"double({x!r})" for x in w[1 : 1 + len(KINDS)])
    votes, features = w[1 + len(KINDS) : 1 + len(KINDS) + len(LABELERS)], w[1 + len(KINDS) + len(LABELERS) :]
    score = f"double({w[0]!r}) + array({by_kind})[c.kind]" + "".join(f" + double({x!r}) * c.votes[{i}]" for i, x in enumerate(votes)) + "".join(f" + double({x!r}) * c.features[{i}]" for i, x in enumerate(features))
    place = lambda sql: F.expr(f"array_sort(transform({sql}, c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end)))")
    out = table.withColumn("base", place(f"filter(`{candidates}`, c -> c.kind < {n_base} AND c.ok)"))
    out = out.withColumn("__more", place(f"filter(`{candidates}`, c -> c.kind >= {n_base} AND {score} >= 0)"))
    out = out.withColumn("__more", F.when(F.size("__more") > 0, F.expr("filter(`__more`, m -> NOT exists(`base`, b -> b.start < m.end AND m.start < b.end))")).otherwise(F.col("__more")))
    return out.select(*[table[c] for c in table.columns if c != candidates], "base", F.array_sort(F.concat("base", "__more")).alias("spans"))


def listed(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda c: F.concat_ws(":", F.get(names, c.kind), c.start.cast("string"), c.end.cast("string"))), ",")


def redacted(text: str = "text", column: str = "spans") -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind, in capitals and angle brackets."""
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    return F.expr(
        f"CASE WHEN size(`{column}`) = 0 THEN `{text}` ELSE aggregate(`{column}`, named_struct('past', 0L, 'out', cast(array() AS array<string>)), "
        f"(a, c) -> named_struct('past', greatest(a.past, c.end), 'out', CASE WHEN c.start < a.past THEN a.out ELSE concat(a.out, array(substring(`{text}`, int(a.past) + 1, int(c.start - a.past)), {names}[c.kind])) END), "
        f"a -> concat(array_join(a.out, ''), substring(`{text}`, int(a.past) + 1))) END"
    )
