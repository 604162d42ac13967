"""Personal data by weak supervision, in DataFrame functions only.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Looser
patterns give candidates: numbers of card length that fail the check digit,
phone numbers without a country sign, spelled-out mail addresses, secrets in
assignments and bare identity-like numbers. On all spans labelers vote for, against or
abstain: the base pattern, the check digit, a gazetteer of endings, prefixes and
key words, words of the context before the span, the characters around it and
its length.

Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is and how likely each pattern is personal data; the counts table has
at most a few thousand rows whatever the input, as every vote has three values. A
logistic span classifier is then trained on these probabilities. It sees what the
labelers don't: which character classes a span has, by kind, and whether a sign of
assignment stands before it, beside the check digit and the context. Candidates
that it accepts are added if they touch no base span and don't start inside an
earlier added one.

Spans are found by cutting the text at the matches, as the lengths of what lies
between give code-point positions. The patterns use possessive quantifiers and
anchor a match where a run of its characters begins, which changes no result and
keeps long texts linear.

Defined results: null and empty texts have no spans; an empty table gives no
rows; repeated rows are searched each; a null doc_id stays null; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, text_or_empty

#: Fixed patterns of the base kinds, in the order of the results.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Fixed patterns of the candidates.
LOCAL_PHONE = r"(?<![0-9A-Za-z.+)(-])(?<![0-9+][\x20-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SPELLED_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,63}+\x20?(?:[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,10}"
SECRET = (
    r"(?<![A-Za-z0-9])(?:(?i:token|api[_-]?key|secret|password|passwd|access[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{12,}+\"?"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:ghp_|sk-|xox[abp]-|AIza)[A-Za-z0-9_-]{16,}+)"
)
BARE_ID = r"(?<![0-9A-Za-z.+-])(?<![0-9)][\x20-])[0-9]{9,15}(?![0-9A-Za-z-])(?![.\x20][0-9])"
#: Fixed values of the gazetteer.
ENDINGS = r"(?i)\.(com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|us|ca|ch|at|nl|cn|jp|in|br|co)$"
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CUES = {
    "email": r"(?i)(mail|contact|write|correo|courriel|kontakt|@)",
    "ip": r"(?i)(\bip\b|host|server|addr|login|from)",
    "card": r"(?i)(card|visa|master|credit|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|ruf|appel|llam)",
    "id": r"(?i)(ssn|passport|\bid\b|account|iban|number|nummer|licen)",
    "secret": r"(?i)(token|key|secret|pass)",
}
VOTES = ("pattern", "check", "gazetteer", "context", "around", "length")
#: What the classifier sees: votes of these labelers, and these features of a span.
SEEN_VOTES = ("check", "context", "length")
FEATURES = ("upper", "lower", "digit", "sign", "assigned")
CONTEXT = 24
BLOCK = 256


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running ``combine`` of whole numbers from 0 on, over blocks of the array, so that long arrays stay linear."""

    def step(state: Column, x: Column) -> Column:
        at = combine(state["at"], x)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    def ahead(state: Column, block: Column) -> Column:
        return F.struct(combine(state["at"], block["at"]).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def blocked(v: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        inside = F.transform(starts, lambda k: F.aggregate(F.slice(v, k, F.lit(BLOCK)), zero, step))
        return F.transform(F.array(inside), lambda i: F.flatten(F.zip_with(i, F.aggregate(i, zero, ahead, lambda s: s["out"]), lambda block, base: F.transform(block["out"], lambda x: combine(base, x)))))[0]

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.array(values), blocked)[0])


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) of the leftmost non-overlapping matches.

    ``before`` are at most ``CONTEXT`` characters since the match before, ``after`` is the next one.
    """

    def placed(both: Column) -> Column:
        found, between = both["found"], both["between"]
        sizes = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: (F.length(b) + F.length(m)).cast("int"))
        pairs = F.zip_with(found, F.slice(between, 2, F.size(found)), lambda m, after: F.struct(m.alias("found"), F.left(after, F.lit(1)).alias("after")))
        lefts = F.zip_with(scan(sizes, lambda a, x: (a + x).cast("int")), F.slice(between, 1, F.size(found)), lambda end, b: F.struct(end.alias("end"), F.right(b, F.lit(CONTEXT)).alias("before")))
        return F.zip_with(pairs, lefts, lambda p, q: F.struct((q["end"] - F.length(p["found"])).cast("int").alias("start"), q["end"].alias("end"), p["found"].alias("found"), q["before"].alias("before"), p["after"].alias("after")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.transform(F.array(both), placed)[0]


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    return F.call_function("luhn_check", digits(found))


def none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")


def small_parts(found: Column) -> Column:
    """Whether all parts of an address are at most 255."""
    return ~found.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind that pass its test."""
    has_digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none()),
        "ip": F.filter(F.when(has_digit & text.rlike(r"[0-9]\.[0-9]"), spans(text, IP)).otherwise(none()), lambda s: small_parts(s["found"])),
        "card": F.filter("cards", lambda s: luhn(s["found"])),
        "phone": F.filter(F.when(F.contains(text, F.lit("+")), spans(text, PHONE)).otherwise(none()), lambda s: F.length(digits(s["found"])).between(8, 15)),
    }


def loose_spans(text: Column) -> dict[str, Column]:
    """Candidates of each kind, base spans not among them or dropped later."""
    return {
        "email": F.when(text.rlike(r"[\[(]at[\])]"), spans(text, SPELLED_MAIL)).otherwise(none()),
        "card": F.filter("cards", lambda s: ~luhn(s["found"])),
        "phone": F.when(text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), spans(text, LOCAL_PHONE)).otherwise(none()),
        "id": F.when(text.rlike("[0-9]{9}"), spans(text, BARE_ID)).otherwise(none()),
        "secret": F.when(text.rlike(r"(?i)(token|key|secret|pass)[a-z]*\x20?[=:]|A[KS]IA[A-Z0-9]{16}|ghp_|sk-|xox[abp]-|AIza"), spans(text, SECRET)).otherwise(none()),
    }


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 abstains."""
    against = F.lit(False) if no is None else F.coalesce(no, F.lit(False))
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(against, -1).otherwise(0)


def voted(kind: str, found: Column, base: bool) -> Column:
    """Array of (kind, start, end, base, votes, features) for the spans of a kind."""
    size = {"email": (6, 60), "ip": (7, 15), "card": (16, 19), "phone": (10, 18), "id": (9, 12), "secret": (20, 80)}[kind]

    def one(s: Column) -> Column:
        value = s["found"]
        before, after = s["before"], s["after"]
        checks = {"card": vote(luhn(value), ~luhn(value)), "id": vote(luhn(value)), "phone": vote(digits(value).rlike("[2-9][0-9]{2}[0-9]{4}$"))}
        places = {
            "email": vote(value.rlike(ENDINGS), ~value.rlike(ENDINGS)),
            "ip": vote(~value.rlike(r"^(0|127|255)\."), value.rlike(r"^(0|127|255)\.")),
            "card": vote(digits(value).rlike(CARD_PREFIX), ~digits(value).rlike(CARD_PREFIX)),
            "phone": vote(value.rlike(r"^\+"), ~value.rlike(r"[-(]")),
            "id": vote(F.lit(False), value.rlike("^(1[0-9]{9}|0+)$")),
            "secret": vote(value.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")),
        }
        loose = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
        long = F.length(value)
        values = {
            "pattern": vote(F.lit(base), F.lit(not base and kind in ("card", "ip"))),
            "check": checks.get(kind, F.lit(0)),
            "gazetteer": places[kind],
            "context": vote(before.rlike(CUES[kind])) if kind != "secret" else F.lit(1),
            "around": vote(~loose, loose),
            "length": vote(long.between(*size), ~long.between(*size)),
        }
        shape = {"upper": value.rlike("[A-Z]"), "lower": value.rlike("[a-z]"), "digit": value.rlike("[0-9]"), "sign": value.rlike("[^A-Za-z0-9]"), "assigned": before.rlike(r"[:=]\x20?\"?$")}
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
            *[values[v].cast("tinyint").alias(v) for v in VOTES], *[shape[f].cast("tinyint").alias(f) for f in FEATURES],
        )

    return F.transform(found, one)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base spans and candidates with their votes."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    text = F.col("text")
    rows = rows.withColumn("cards", F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), spans(text, CARD)).otherwise(none()))
    base, loose = base_spans(text), loose_spans(text)
    rows = rows.withColumns({f"b_{k}": c for k, c in base.items()} | {f"l_{k}": c for k, c in loose.items()})
    arrays = [voted(k, F.col(f"b_{k}"), True) for k in base] + [voted(k, F.col(f"l_{k}"), False) for k in loose]
    return rows.select("doc_id", F.concat(*arrays).alias("spans"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Share of personal data by kind, P(vote | label) of each labeler, and each pattern's probability."""
    kinds = sorted({k for k, _, _ in patterns})
    kind = np.array([kinds.index(k) for k, _, _ in patterns])
    votes = np.array([v for _, v, _ in patterns]) + 1
    weight = np.array([n for _, _, n in patterns], dtype=float)
    p = 1 / (1 + np.exp(-(votes - 1).sum(axis=1)))  # the majority vote is where it starts
    rate = np.zeros((2, len(VOTES), 3))
    for _ in range(rounds):
        for label, share in enumerate((1 - p, p)):
            for j in range(len(VOTES)):
                rate[label, j] = np.bincount(votes[:, j], weight * share, 3) + 1.0
        # a labeler is better than chance: votes for are likelier under 1, votes against under 0
        rate /= rate.sum(axis=2, keepdims=True)
        prior = np.array([(np.sum((weight * p)[kind == k]) + 1) / (np.sum(weight[kind == k]) + 2) for k in range(len(kinds))])
        ratio = np.log(prior / (1 - prior))[kind]
        for j in range(len(VOTES)):
            step = np.log(rate[1, j] / rate[0, j])
            step = np.array([min(step[0], 0.0), step[1], max(step[2], 0.0)])
            ratio = ratio + step[votes[:, j]]
        p = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
    return dict(zip(kinds, prior.tolist(), strict=True)), rate, p


def train(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], probabilities: np.ndarray, steps: int = 30, ridge: float = 1.0) -> dict[str, float]:
    """Weights of a logistic classifier on kinds, features by kind and seen votes, trained on the estimated probabilities."""
    names = ["bias", *[f"kind={k}" for k in KINDS], *[f"{k}&{f}" for k in KINDS for f in FEATURES], *[f"{v}={x}" for v in SEEN_VOTES for x in (-1, 1)]]
    place = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for row, (k, votes, features, _) in enumerate(rows):
        own = ["bias", f"kind={k}", *[f"{k}&{f}" for f, on in zip(FEATURES, features, strict=True) if on], *[f"{v}={value}" for v, value in zip(VOTES, votes, strict=True) if value and v in SEEN_VOTES]]
        x[row, [place[n] for n in own]] = 1
    weight = np.array([n for *_, n in rows], dtype=float)
    weight *= 1000 / weight.sum()
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * 0.01 * np.eye(len(names))
        w += np.linalg.solve(hessian, x.T @ (weight * (probabilities - p)) - ridge * 0.01 * w)
    return dict(zip(names, w.tolist(), strict=True))


def logit(s: Column, weights: dict[str, float]) -> Column:
    total = F.lit(weights.get("bias", 0.0))
    for k in KINDS:
        own = F.lit(weights.get(f"kind={k}", 0.0))
        for f in FEATURES:
            own = own + F.when(s[f] == 1, weights.get(f"{k}&{f}", 0.0)).otherwise(0.0)
        total = total + F.when(s["kind"] == k, own).otherwise(0.0)
    for v in SEEN_VOTES:
        total = total + F.when(s[v] == 1, weights.get(f"{v}=1", 0.0)).when(s[v] == -1, weights.get(f"{v}=-1", 0.0)).otherwise(0.0)
    return total


def learn(rows: DataFrame) -> dict[str, float]:
    """The classifier's weights from the counts of (kind, votes, features); 6 * 3 ** 6 * 2 ** 5 rows at most reach the driver."""
    counted = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", *[F.col(f"s.{c}") for c in VOTES + FEATURES]).agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["kind"], tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES), r["n"]) for r in counted.collect())
    if not found:
        return {}
    sums: dict[tuple[str, tuple[int, ...]], int] = {}
    for k, votes, _, n in found:
        sums[k, votes] = sums.get((k, votes), 0) + n
    _, _, p = estimate([(k, votes, n) for (k, votes), n in sums.items()])
    by_votes = dict(zip(sums, p.tolist(), strict=True))
    return train(found, np.array([by_votes[k, votes] for k, votes, *_ in found]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (order, start, end, kind), base spans and those the classifier adds."""
    rows = cut(candidates(docs))
    weights = learn(rows)
    order = {k: i for i, k in enumerate(KINDS)}

    def placed(s: Column) -> Column:
        rank = F.lit(0)
        for k, i in order.items():
            rank = F.when(s["kind"] == k, i).otherwise(rank)
        return F.struct(rank.cast("int").alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))

    base = F.filter("spans", lambda s: s["base"])
    accepted = F.filter("spans", lambda s: ~s["base"] & (logit(s, weights) > 0) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    found = rows.select("doc_id", base.alias("base"), "spans").select("doc_id", F.array_sort(F.transform("base", placed)).alias("base"), F.array_sort(F.transform(accepted, lambda s: F.struct(s["start"].alias("start"), placed(s).alias("span")))).alias("added"))
    reached = F.concat(F.array(F.lit(0)), scan(F.transform("added", lambda s: s["span"]["end"]), F.greatest))
    apart = F.filter(F.zip_with("added", F.slice(reached, 1, F.size("added")), lambda s, end: F.struct(s["span"].alias("span"), (s["start"] >= end).alias("apart"))), lambda s: s["apart"])
    return found.select("doc_id", "base", F.array_sort(F.transform(apart, lambda s: s["span"])).alias("added"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans per row of ``docs``."""
    found = find_personal_data(docs)

    def joined(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets, row by row: repeated and null doc_ids meet only their own spans."""
    numbers, key = numbered(docs)
    found = find_personal_data(numbers.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("__id"), F.concat("base", "added").alias("__spans"))
    rows = numbers.select(key, "doc_id", text_or_empty().alias("text")).join(found, F.col(key) == F.col("__id"))
    by_start = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.when(skip, acc["at"]).otherwise(s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(out).alias("out"))

    text = F.aggregate(by_start, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", text.alias("text"))
