"""Personal data: candidate spans by high-recall patterns, boosted trees over format and context, calibrated thresholds.

The main path is DataFrame functions only. For each base kind there is a strict generator, whose spans are always kept when its checks pass
(see ``STRICT``), and for these and for secrets a wide one (``WIDE``), whose candidates overlap the strict ones and each other. Every wide
candidate is described by its own format and the 40 characters around it; gradient-boosted trees turn this into a probability, and those at or
above the threshold of their kind become spans where no strict span overlaps them. Of wide candidates that overlap in a chain, the likeliest stays.

The trees and thresholds are fitted on the driver on candidates in at most ``CARRIERS`` texts of the table itself, each of at most
``CARRIER_CHARS`` characters: forms of personal data and look-alikes (order numbers, dates, versions, checksums) are planted between their
words ``TRAINING`` times, and the texts' own candidates count where they are certain (one that a strict span confirms, a number that fails
its check digit). Of four parts of these texts two fit the trees, the third sets the threshold of each kind, the lowest at which its candidates there reach ``PRECISION``,
and the fourth, which neither saw, gives the figures that are reported. The trees are then column expressions. Runs of characters and private keys count whole, however long.

Positions come from the pieces between matches: a match begins after all pieces and matches before it, summed by a window
over the candidates of one document; texts themselves are never shuffled.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import hashed_rows, written

KINDS = ("email", "ip", "card", "phone")
#: With the kind that only the method finds.
ALL = (*KINDS, "secret")
#: kind -> (gate, pattern). Patterns match what the plain forms match, without their backtracking: \G lets a match begin where the last ended.
STRICT = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][0-9 -]{14}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
WIDE = {
    "email": (
        r"(?i)[\[({ ]at[\])} ]",
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?: ?[\[({] ?at ?[\])}] ?| at )[a-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[a-z0-9-]{1,63}){1,5}",
    ),
    "ip": (r"(?i)[0-9a-f]?:[0-9a-f]{0,4}:", r"(?i)(?<![\w:.])(?:[0-9a-f]{1,4}|:)?(?::[0-9a-f]{0,4}){2,7}(?![\w:])"),
    "card": (r"[0-9][0-9 .-]{12}", r"(?<![0-9])(?:[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}|[0-9]{13,19})(?![0-9])"),
    "phone": (r"[0-9][ ./)-]{1,2}[0-9]{2}", r"(?<![0-9+./-])(?:\([0-9]{2,5}\) ?|0{0,2}[0-9]{2,5}[ ./-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9./-])"),
    "secret": (
        r"(?i)token|secret|passw|pwd|api.?key|access.?key|auth|bearer|-----BEGIN|[A-Za-z0-9_/+-]{20}",
        r"(?i)-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:\s*+Proc-Type:[^\n]*+\n)?+(?:DEK-Info:[^\n]*+\n)?+[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?+"
        r"|(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![A-Za-z0-9_/+=-])",
    ),
}
CUES = {
    "mail": r"(?i)mail|contact|write",
    "net": r"(?i)\bip\b|host|server|address|login",
    "pay": r"(?i)card|visa|credit|paid|payment|account",
    "call": r"(?i)phone|\btel|call|mobile|fax|sms|whatsapp",
    "other": r"(?i)order|ref|isbn|version|page|serial|invoice|tracking|part no|build|date|\bid\b|commit|checksum|md5|sha|digest|hash|time|clock|uuid",
    "key": r"(?i)token|secret|passw|pwd|\bkey|apikey|auth|bearer|credential",
    "set": r"[:=] ?[\"']?$",
}
FEATURES = (
    "kind", "length", "digits", "luhn", "distinct", "separators", "first", "spaced", "letter_before", "letter_after", "digit_near", "decimal_near",
    "colons", "doubled", "letters", "upper", "different", "slashes", "marked", "at_marked", "dot_word", "cue_mail", "cue_net", "cue_pay", "cue_call", "cue_other", "cue_key", "cue_set",
)
#: How keys of well-known kinds begin.
MARKS = ("-----BEGIN", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ", "sk-", "sk_")
TRAINING, CARRIERS, CARRIER_CHARS, PRECISION, CONTEXT = 2400, 300, 2000, 0.98, 40


def matches(text: Column, gate: str, pattern: str) -> Column:
    """An array of (place, skipped, left, found, right) of all matches from the left; empty unless the gate is found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def facts(pieces: Column, m: Column) -> Column:
        return F.transform(
            m,
            lambda x, i: F.struct(
                i.alias("place"),
                F.length(F.get(pieces, i)).alias("skipped"),
                F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("left"),
                x.alias("found"),
                F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("right"),
            ),
        )

    bound = F.flatten(F.transform(F.array(F.split(text, pattern, -1)), lambda p: F.flatten(F.transform(F.array(found), lambda m: facts(p, m)))))
    seen = F.contains(text, F.lit(gate)) if gate == "@" else text.rlike(gate)
    return F.when(seen, bound).otherwise(F.array().cast("array<struct<place:int,skipped:int,left:string,found:string,right:string>>"))


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def octets_fit(found: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) > 3, F.lit(False)).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), fits)


def candidates(docs: DataFrame) -> DataFrame:
    """(row, id, kind, strict, place, left, found, right, start, finish) of all candidates; documents without any have one row of null kind."""

    def labelled(k: int, strict: bool, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(k).alias("kind"), F.lit(strict).alias("strict"), m.alias("m")))

    lists = [
        labelled(k, strict, matches(F.col("text"), *source[kind]))
        for strict, source in ((True, STRICT), (False, WIDE))
        for k, kind in enumerate(ALL)
        if kind in source
    ]
    spans = docs.select("row", "id", F.inline_outer(F.concat(*lists)))
    spans = spans.select("row", "id", "kind", "strict", "m.*")
    order = Window.partitionBy("row", "kind", "strict").orderBy("place")
    finish = F.sum(F.col("skipped") + F.length("found")).over(order)
    return spans.withColumn("finish", finish).withColumn("start", F.col("finish") - F.length("found"))


def checked(spans: DataFrame) -> DataFrame:
    """Adds digits, n_digits and passes: what the strict generator of the kind requires."""
    digits = F.regexp_replace("found", "[^0-9]", "")
    n = F.length("digits")
    passes = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, octets_fit(F.col("found")))
        .when(F.col("kind") == 2, n.between(16, 19) & luhn(F.col("digits")))
        .otherwise(n.between(8, 15))
    )
    return spans.withColumn("digits", digits).withColumn("n_digits", n).withColumn("passes", F.col("strict") & passes)


def described(spans: DataFrame) -> DataFrame:
    """Adds x: the features of each candidate as an array of doubles."""
    around = F.concat("left", F.lit(" "), "right")
    values = {
        "kind": F.col("kind"), "length": F.length("found"), "digits": F.col("n_digits"),
        "luhn": F.when(F.col("n_digits").between(13, 19), luhn(F.col("digits"))).otherwise(False).cast("int"),
        "distinct": F.size(F.array_distinct(F.split(F.col("digits"), ""))), "separators": F.length(F.regexp_replace("found", "[A-Za-z0-9]", "")),
        "first": F.coalesce(F.left("digits", F.lit(1)).try_cast("int"), F.lit(-1)), "spaced": F.col("found").contains(" ").cast("int"),
        "letter_before": F.col("left").rlike(r"\p{L}$").cast("int"), "letter_after": F.col("right").rlike(r"^\p{L}").cast("int"),
        "digit_near": around.rlike("[0-9]").cast("int"), "decimal_near": (F.col("left").rlike(r"[0-9.,:/-]\s?$") | F.col("right").rlike(r"^\s?[.,:/-]?[0-9]")).cast("int"),
        "colons": F.length(F.regexp_replace("found", "[^:]", "")), "doubled": F.col("found").contains("::").cast("int"),
        "letters": F.length(F.regexp_replace("found", "[^A-Za-z]", "")), "upper": F.length(F.regexp_replace("found", "[^A-Z]", "")),
        "different": F.size(F.array_distinct(F.split(F.col("found"), ""))), "slashes": F.length(F.regexp_replace("found", "[^/_-]", "")),
        "marked": F.col("found").rlike(r"(?i)^(?:" + "|".join(MARKS) + ")").cast("int"),
        "at_marked": F.col("found").rlike(r"(?i)[\[({] ?at").cast("int"), "dot_word": F.col("found").rlike(r"(?i)[\[({ ]dot[\])} ]").cast("int"),
    } | {f"cue_{name}": (F.col("left") if name in ("set", "key") else around).rlike(pattern).cast("int") for name, pattern in CUES.items()}
    return spans.withColumn("x", F.array(*[F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in FEATURES]))


@dataclass
class Trees:
    """base + sum of trees; a tree is a number or (feature, cut, tree below the cut, tree at or above it)."""

    base: float
    trees: list
    thresholds: list[float]
    measured: dict[str, tuple] = field(default_factory=dict)  # kind -> precision and recall of candidates that neither fit nor thresholds saw

    def margin(self, x: np.ndarray) -> np.ndarray:
        def value(tree, rows: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            f, cut, low, high = tree
            return np.where(rows[:, f] < cut, value(low, rows), value(high, rows))

        return self.base + sum(value(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        def value(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, cut, low, high = tree
            return F.when(F.get(x, F.lit(f)) < F.lit(float(cut)), value(low)).otherwise(value(high))

        margin = reduce(lambda a, b: a + b, [value(t) for t in self.trees], F.lit(self.base))
        return 1.0 / (1.0 + F.exp(-margin))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, floor: float):
    def leaf() -> float:
        return float(g.sum() / (h.sum() + floor))

    if depth == 0 or len(g) < 8:
        return leaf()
    best, where = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + floor)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in values[1:] if len(values) <= 12 else np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9))):
            low = x[:, f] < cut
            if low.any() and not low.all():
                got = g[low].sum() ** 2 / (h[low].sum() + floor) + g[~low].sum() ** 2 / (h[~low].sum() + floor) - whole
                if got > best:
                    best, where = got, (f, float(cut), low)
    if where is None:
        return leaf()
    f, cut, low = where
    return (f, cut, grow(x[low], g[low], h[low], depth - 1, floor), grow(x[~low], g[~low], h[~low], depth - 1, floor))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.35) -> Trees:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))), [], [])
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))

        def scaled(tree):
            return (tree[0], tree[1], scaled(tree[2]), scaled(tree[3])) if isinstance(tree, tuple) else rate * tree

        tree = scaled(grow(x, y - p, p * (1 - p), depth, 1.0))
        model.trees.append(tree)
        margin = margin + Trees(0.0, [tree], []).margin(x)
    return model


def planted(carriers: list[str], n: int, seed: int = 10) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(id, text, [(kind, start, end)]) of n texts: carriers with forms of personal data and, as kind -1, look-alikes between their words."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((14, 14, 14, 15)))
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        raw = body + str(-total % 10)
        sep = rng.choice(("", "", " ", "-", "."))
        return sep.join(raw[k : k + 4] for k in range(0, len(raw), 4)) if sep and len(raw) == 16 else raw

    def name() -> str:
        return "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9)))

    def address() -> str:
        groups = [f"{rng.randrange(65536):x}" for _ in range(8)]
        if rng.random() < 0.4:
            low = rng.randint(1, 5)
            return ":".join(groups[:low]) + "::" + ":".join(groups[low + 2 :])
        return ":".join(groups)

    def phone() -> str:
        sep = rng.choice("-. ")
        return rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", sep.join((digits(3), digits(3), digits(4))), f"0{digits(3)}/{digits(3)} {digits(4)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(4)}"))

    def key() -> str:
        kind = rng.choice(("RSA ", "EC ", "OPENSSH ", ""))
        body = "\n".join(mixed(64) for _ in range(rng.randint(0, 8)))
        return f"-----BEGIN {kind}PRIVATE KEY-----" + (f"\n{body}\n-----END {kind}PRIVATE KEY-----" if body else "")

    right = {
        0: lambda: f"{name()}{rng.choice((' [at] ', '(at)', ' (at) ', '[at]', ' at '))}{name()}{rng.choice((' [dot] ', '(dot)', ' dot '))}com" if rng.random() < 0.7 else f"{name()}{rng.choice((' [at] ', '(at)'))}{name()}.com",
        1: address, 2: card, 3: phone,
        4: lambda: rng.choice((hexa(40), hexa(32), mixed(24), mixed(32), mixed(40), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(40), "eyJ" + mixed(60), mixed(rng.choice((240, 600))), key())),
    }
    cues = {
        0: ("mail me at ", "contact ", ""), 1: ("server ", "my ip is ", "host ", ""), 2: ("card ", "visa number ", "paid with ", "", ""), 3: ("call ", "phone ", "tel. ", "my mobile is "),
        4: ('token = "', "api_key: ", "password=", 'secret = "', "Authorization: Bearer ", 'auth_token: "', 'access key "'),
    }
    wrong = [
        lambda: f"order {digits(16)}", lambda: f"invoice {digits(14)}", lambda: f"tracking {digits(13)}", lambda: f"{digits(17)}", lambda: f"serial {digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{rng.randint(1990, 2030)} {digits(3)} {digits(3)}", lambda: f"part no {digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"page {digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)} {digits(3)} {digits(4)}", lambda: f"id {digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
        lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: f"meet (at) {name()}. {name()} left", lambda: f"version {digits(2)}.{digits(4)}.{digits(3)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}",
        lambda: f"look at {name()}.{name()}", lambda: f"at {rng.randint(10, 23)}:{digits(2)}:{digits(2)}", lambda: f"std::{name()}::{name()}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{digits(2)}:{digits(2)}",
        lambda: f"commit {hexa(40)}", lambda: f"md5 {hexa(32)}", lambda: f"sha256 {hexa(64)}", lambda: f"uuid {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: "-".join(name() for _ in range(4)),
        lambda: "/".join(name() for _ in range(5)), lambda: "_".join(name() for _ in range(4)), lambda: name() + name() + name(), lambda: "=" * 30, lambda: "-" * 40, lambda: digits(30),
        lambda: f"data:image/png;base64,{mixed(rng.choice((120, 400)))}", lambda: "_" * 300, lambda: "-".join(name() for _ in range(60)),
    ]
    out = []
    for k in range(n):
        words = carriers[k % len(carriers)].split(" ") if carriers else [name() for _ in range(40)]
        at = sorted(rng.randint(0, len(words)) for _ in range(rng.randint(2, 5)))
        text, spans, done = "", [], 0
        for place in at:
            text += "".join(w + " " for w in words[done:place])
            done = place
            if rng.random() < 0.5:
                kind = rng.randrange(len(ALL))
                span = right[kind]()
                alone = ("", "see ", "found\n") if kind == 4 and span.startswith(MARKS) else ()  # what tells itself needs no cue
                text += (cue := rng.choice(cues[kind] + alone))
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + ('"' if cue.endswith('"') else "")
            else:
                span = rng.choice(wrong)()
                spans.append((-1, len(text), len(text) + len(span)))
                text += span
            text += rng.choice((" ", ". ", ", "))
        out.append((k, text + " ".join(words[done:]), spans))
    return out


def labelled(rows: list, truth: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and text of the candidates whose label is certain."""
    strict: dict = {}
    for r in rows:
        if r.strict and r.passes:
            strict.setdefault(r.id, []).append((r.kind, r.start, r.finish))
    x, y, owner = [], [], []
    for r in rows:
        if r.strict:
            continue
        meets = lambda spans: {k for k, a, b in spans if a < r.finish and r.start < b}  # noqa: B023, E731
        inserted, confirmed = meets(truth[r.id]), meets(strict.get(r.id, []))
        label = 1 if r.kind in inserted | confirmed else 0 if inserted | confirmed or (r.kind == 2 and not r.x[FEATURES.index("luhn")]) else None
        if label is not None:
            x.append(r.x)
            y.append(float(label))
            owner.append(r.id)
    return np.array(x).reshape(-1, len(FEATURES)), np.array(y), np.array(owner, dtype=np.int64)


def fitted(texts: DataFrame, n: int = TRAINING, precision: float = PRECISION) -> Trees:
    """The trees and thresholds; features come from the same columns as on the main path.

    One model can be given to ``find_pii`` for all parts of a corpus. ``measured`` has each kind's figures on the part that neither fit nor thresholds saw.
    """
    fit_in = texts.select("text").where(F.length("text").between(40, CARRIER_CHARS))
    carriers = sorted(r.text for r in hashed_rows(fit_in, "text", CARRIERS, seed=10))
    made = planted(carriers, n)
    truth = {k: spans for k, _, spans in made}
    listed = F.lit(json.dumps([{"row": k, "id": k, "text": t} for k, t, _ in made]))
    spark = texts.sparkSession
    docs = spark.range(1).select(F.inline(F.from_json(listed, "array<struct<row:bigint,id:bigint,text:string>>"))).repartition(spark.sparkContext.defaultParallelism)
    rows = described(checked(candidates(docs))).where("kind is not null").select("id", "kind", "strict", "passes", "start", "finish", "x").collect()
    x, y, owner = labelled(sorted(rows, key=lambda r: (r.id, r.kind, r.start, r.strict)), truth)
    part = owner % 4  # of texts
    model = boost(x[part < 2], y[part < 2])
    p = 1 / (1 + np.exp(-model.margin(x)))
    for kind in range(len(ALL)):
        own = x[:, 0] == kind
        sets, told = own & (part == 2), own & (part == 3)
        cut = 1.01
        for c in sorted(set(p[sets].tolist()), reverse=True):
            if y[sets & (p >= c)].mean() >= precision:
                cut = c
        model.thresholds.append(float(max(cut, 0.5)))
        taken, right = told & (p >= model.thresholds[-1]), y[told].sum()
        model.measured[ALL[kind]] = (float(y[taken].mean()) if taken.any() else None, float(y[taken].sum() / right) if right else None)
    return model


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (strict spans), n_added (others), base (sorted strict spans) and spans (all), as
    arrays of (kind number, start, end) in code points, ends exclusive.

    Null texts are empty; repeated rows and null ids each have their own result; further columns are ignored. Without a model one is fitted on the table.
    """
    texts = texts_of(docs, id_col, text_col)
    return found_in(texts.withColumn("row", F.monotonically_increasing_id()), model or fitted(texts)).drop("row")


def found_in(texts: DataFrame, model: Trees) -> DataFrame:
    """The same of (row, id, text), with the row's number."""
    spans = checked(candidates(texts))
    scored = described(spans).withColumn("p", F.when(F.col("kind").isNotNull() & ~F.col("strict"), model.column(F.col("x"))))
    cut = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(model.thresholds[k])), range(1, len(ALL)), F.when(F.col("kind") == 0, F.lit(model.thresholds[0])))
    scored = scored.withColumn("maybe", F.coalesce(~F.col("strict") & (F.col("p") >= cut), F.lit(False)))
    kept = scored.where("kind is null or passes or maybe or place = 0").select("row", "id", "kind", "strict", "start", "finish", "passes", "maybe", "p")
    by_start = Window.partitionBy("row").orderBy("start", "finish", "kind", "strict")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("finish"), F.desc("kind"), F.desc("strict")).rowsBetween(Window.unboundedPreceding, -1)  # linear, unlike a frame that ends ahead
    kept = kept.withColumn("reach", F.max(F.when(F.col("passes"), F.col("finish"))).over(before)).withColumn("ahead", F.min(F.when(F.col("passes"), F.col("start"))).over(after))
    free = F.col("maybe") & ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("ahead") < F.col("finish"), F.lit(False))
    kept = kept.withColumn("free", free).withColumn("upto", F.max(F.when(F.col("free"), F.col("finish"))).over(before))
    new = (F.col("free") & ~F.coalesce(F.col("upto") > F.col("start"), F.lit(False))).cast("int")
    kept = kept.withColumn("chain", F.sum(new).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    likeliest = F.row_number().over(Window.partitionBy("row", "chain", "free").orderBy(F.col("p").desc(), "start", F.col("finish").desc(), "kind")) == 1
    kept = kept.withColumn("added", F.col("free") & likeliest)
    span = F.struct("kind", F.col("start").cast("bigint").alias("start"), F.col("finish").cast("bigint").alias("end"))
    found = kept.groupBy("row", "id").agg(
        *[F.count_if(F.col("passes") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.count_if("added").alias("n_added"),
        F.sort_array(F.collect_list(F.when(F.col("passes"), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("passes") | F.col("added"), span))).alias("spans"),
    )
    return found


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """(id, text), one row per input row: each text with its spans replaced by the kind in angle brackets; overlapping spans are replaced as one, under the first's kind.

    Rows are numbered once, in a written table, and told by these numbers, so null and repeated ids are rows like others.
    """
    texts = written(texts_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "texts")
    found = found_in(texts, model or fitted(texts)).select("row", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("s"))
    both = texts.join(found, "row")
    names = F.array(*[F.lit(f"<{k}>") for k in ALL])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        skipped = F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], skipped, F.get(names, s["kind"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("s", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return both.select("id", done.alias("text"))
