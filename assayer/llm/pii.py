"""Personal data by weak supervision, in DataFrame functions only.

Base patterns (e-mail, IP, card, phone) give spans that always stay. Looser
patterns add candidates that may be personal data too: of these kinds, and account
numbers (IBAN, and bare numbers after a word for them), dates of birth, names after a
title or an introduction, street addresses, and secrets (keys and passwords). Four
labelers vote on each candidate (+ for, - against, 0 no opinion): the pattern itself
with its checksum or range, a gazetteer (endings, issuers, countries, address blocks,
given names, kinds of streets), the words before it, and the characters that touch it.
Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic span classifier is
then trained on these likelihoods with the votes and the length as features and
decides on the loose candidates.

Offsets come from the gaps between matches, so a span costs no second search. Vote
patterns are at most kinds x 3^4 x lengths rows, whatever the size of the corpus, and
only these counts reach the driver. `find` scans the text once and writes the
candidates; `mask` scans it twice and writes nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "birth", "name", "address", "secret")

#: Fixed base patterns. The look-behinds only skip starts from which no leftmost match can begin.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",  # possessive: a loop, not a recursion for each label
    "ip": r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9][0-9 -]*[0-9]",  # over text whose double separators are blanked, see _single
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser patterns: written-out at signs, IPv6, cards of 15 digits, phone numbers without a country code.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "account": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8,15})(?![A-Za-z0-9-])",
    "birth": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])",
    "name": r"(?:(?<=\b(?:Mr|Ms|Dr|Mrs|Mme|Sra|Herr|Frau)\.? )|(?<=\b(?:my name is|name:|ich heiße|je m'appelle|me llamo) ))\p{Lu}\p{Ll}{1,30}(?:[ -]\p{Lu}\p{Ll}{1,30}){0,3}",
    "address": r"(?<![\p{L}0-9])(?:[0-9]{1,5} (?:\p{Lu}\p{Ll}{1,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)|\p{Lu}\p{Ll}{1,30}(?:straße|strasse|weg|gasse|platz) [0-9]{1,4}|[0-9]{1,4},? (?:rue|avenue|boulevard) (?:d[eu] )?(?:la )?\p{L}{2,30}|(?:Calle|Avenida|Plaza) (?:de )?(?:la )?\p{L}{2,30},? [0-9]{1,4})(?![\p{L}0-9])",
    "secret": r"(?<=(?i:token|key|secret|password|passwd)[\"']? ?[:=] ?[\"']?)[A-Za-z0-9_+/.-]{8,200}",
}
#: What a text must hold before a pattern is tried on it; each is implied by a match.
HINT = {
    ("email", True): ("has", "@"),
    ("ip", True): ("like", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    ("card", True): ("like", r"[0-9](?:[ -]?[0-9]){15}"),
    ("phone", True): ("has", "+"),
    ("email", False): ("like", r"[(\[{]at[)\]}]"),
    ("ip", False): ("like", r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    ("card", False): ("like", r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
    ("phone", False): ("like", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    ("account", False): ("like", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}"),
    ("birth", False): ("like", r"[0-9][./-][0-9]{1,2}[./-][0-9]{2}"),
    ("name", False): ("like", r"(?:Mr|Ms|Dr|Mrs|Mme|Sra|Herr|Frau|my name is|name:|ich heiße|je m'appelle|me llamo)\.? \p{Lu}"),
    ("address", False): ("like", r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)\b|(?:straße|strasse|weg|gasse|platz|rue|avenue|boulevard|Calle|Avenida|Plaza) "),
    ("secret", False): ("like", r"(?i)(?:token|key|secret|password|passwd)[\"']? ?[:=]"),
}
#: Gazetteers: top-level domains, address blocks, card issuers' first digits, country codes, countries with IBANs, years
#: of people alive, given names, street words, prefixes of issued keys.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|ch|at|eu|us|ca|jp|cn|br|ru|test|example)$",
    "ip": r"^(?:10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|(?i:fe80|fd|fc|2001))",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])",
    "account": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)[0-9]",
    "birth": r"(?:19[2-9][0-9]|20[01][0-9])",
    "name": r"^(?:James|John|Mary|Anna|Anne|Peter|Paul|Michael|Thomas|David|Sarah|Laura|Emma|Robert|Hans|Klaus|Jürgen|Sabine|Petra|Ute|Karl|Julia|Pierre|Jean|Marie|Luc|Claire|Sophie|Michel|Camille|José|Juan|Carlos|María|Ana|Luis|Carmen|Pablo|Lucía|Miguel)\b",
    "address": r"(?i)(?:street|avenue|road|lane|drive|boulevard|straße|strasse|weg|gasse|platz|rue|calle|avenida|plaza)",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk[-_]|pk[-_]|xox[bp]-|eyJ)",
}
#: Words before a candidate that speak for its kind.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|courriel|correo)[^\n]*$",
    "ip": r"(?i)(?:\bip\b|host|server|addr|from|adresse)[^\n]*$",
    "card": r"(?i)(?:card|visa|master|amex|pay|karte|carte|tarjeta)[^\n]*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|anruf|appel|llam)[^\n]*$",
    "account": r"(?i)(?:iban|account|acct|bank|ssn|social security|passport|konto|compte|cuenta|ausweis|pasaporte)[^\n]*$",
    "birth": r"(?i)(?:born|birth|d\.?o\.?b\b|geboren|geb\.|naissance|née?\b|nacid[oa]|nacimiento)[^\n]*$",
    "name": r"(?i)(?:name|signed|regards|called|heiße|appelle|llamo|\b(?:mr|ms|dr|mrs|mme|sra|herr|frau)\.? )$|(?i)(?:name is|name:|heiße|appelle|llamo) $",
    "address": r"(?i)(?:address|live[sd]?|resid|deliver|ship|adresse|wohn|habite|direcci|vive)[^\n]*$",
    "secret": r"(?i)(?:token|key|secret|password|passwd)[^\n]*$",
}
#: Matches that are walked in one go.
BLOCK = 128
SPAN = "struct<kind:int,start:bigint,end:bigint,base:boolean,votes:string,shape:int>"
_HITS = "struct<pos:bigint,i:int,out:array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _single(text: Column) -> Column:
    """The text with each blank or hyphen that touches another one replaced; code points keep their places."""
    return F.regexp_replace(text, r"(?<=[ -])[ -]|[ -](?=[ -])", "x")


def _hits(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start, end (code points), hit, and the text around."""

    def walk(x: Column) -> Column:
        def step(acc: Column, hit: Column) -> Column:
            gap = x["gaps"][acc["i"]]
            start = acc["pos"] + F.length(gap)
            end = start + F.length(hit)
            one = F.struct(start.alias("start"), end.alias("end"), hit.alias("hit"), F.right(gap, F.lit(32)).alias("before"), F.left(x["gaps"][acc["i"] + 1], F.lit(4)).alias("after"))
            return F.struct(end.alias("pos"), (acc["i"] + 1).alias("i"), F.array_append(acc["out"], one).alias("out"))

        def block(b: Column, start: Column) -> Column:
            first = F.struct(start.alias("pos"), (b * BLOCK).alias("i"), F.array().alias("out")).cast(_HITS)
            return F.aggregate(F.slice(x["hits"], b * BLOCK + 1, F.lit(BLOCK)), first, step)["out"]

        # matches are walked in blocks, since an array that grows by one at a time is copied each time
        ends = F.transform(x["hits"], lambda hit, i: (F.length(x["gaps"][i]) + F.length(hit)).cast("bigint"))
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x["hits"]) - 1) / F.lit(BLOCK)).cast("int")))
        sizes = F.transform(blocks, lambda b: F.aggregate(F.slice(ends, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("bigint"), lambda t, n: t + n))
        starts = F.aggregate(sizes, F.expr("cast(array(0L) as array<bigint>)"), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))
        return F.flatten(_let(starts, lambda at: F.transform(blocks, lambda b: block(b, at[b]))))

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), walk)


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _remainder_97(hit: Column) -> Column:
    """An IBAN's check: its first four characters go to the end, letters count from 10, and the number modulo 97 is 1."""
    bare = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.left(bare, F.lit(4)))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    digits = F.array_join(F.transform(letters, lambda c: F.when(c.rlike("^[0-9]$"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda rest, d: (rest * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97)


def _worth(kind: str, x: Column) -> Column:
    """Whether a loose match is a candidate: numbers and dates by themselves are nothing without a word for them."""
    if kind == "account":
        return x["hit"].rlike("^[A-Z]") | x["before"].rlike(CONTEXT["account"])
    if kind == "birth":
        return x["before"].rlike(CONTEXT["birth"])
    return F.lit(True)


def _votes(kind: str, base: bool, x: Column) -> Column:
    hit, digits = x["hit"], F.regexp_replace(x["hit"], "[^0-9]", "")
    named = digits if kind == "card" else hit
    yes, no, none = F.lit("+"), F.lit("-"), F.lit("0")
    checked = {
        "card": F.when(F.call_function("luhn_check", digits), yes).otherwise(no),
        "account": F.when(~hit.rlike("^[A-Z]"), none).when(_remainder_97(hit) == 1, yes).otherwise(no),
        "birth": F.when(hit.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-]|^(?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]|-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"), yes).otherwise(no),
        "name": F.when(hit.rlike(r"[ -]"), yes).otherwise(none),
        "secret": F.when(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"), yes).otherwise(no),
    }
    pattern = yes if base else checked.get(kind, none)
    gazetteer = F.when(named.rlike(GAZETTEER[kind]), yes).otherwise(none if kind in ("ip", "account", "name", "secret") else no)
    context = F.when(x["before"].rlike(CONTEXT[kind]), yes).otherwise(none)
    touches = F.when(x["before"].rlike(r"[\p{L}\p{N}_./:#]$" if kind == "secret" else r"[\p{L}\p{N}_./:#=]$") | x["after"].rlike(r"^(?:[\p{L}\p{N}_/:=]|[.-][0-9])"), no).otherwise(yes)
    return F.concat(pattern, gazetteer, context, touches)


def _spans(text: Column, kind: str, base: bool) -> Column:
    how, what = HINT[kind, base]
    hint = F.contains(text, F.lit(what)) if how == "has" else text.rlike(what)
    found = _hits(_single(text) if kind == "card" and base else text, (BASE if base else LOOSE)[kind])
    found = F.filter(found, lambda x: _valid(kind, x["hit"]) if base else _worth(kind, x))
    rows = F.transform(
        found,
        lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.lit(base).alias("base"),
            _votes(kind, base, x).alias("votes"),
            F.least((x["end"] - x["start"]).cast("int") / 4, F.lit(7)).cast("int").alias("shape"),
        ),
    )
    return F.when(hint, rows.cast(f"array<{SPAN}>")).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def candidates(text: Column) -> Column:
    """Base spans, and loose ones that touch no base span, by kind and start."""
    base = F.concat(*[_spans(text, k, True) for k in BASE_KINDS])
    loose = F.concat(*[_spans(text, k, False) for k in KINDS])
    return _let(
        F.struct(base.alias("b"), loose.alias("l")),
        lambda x: F.array_sort(F.concat(x["b"], F.filter(x["l"], lambda s: ~F.exists(x["b"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))),
    )


def reliabilities(counts: dict[tuple[str, int], int], rounds: int = 30) -> dict[tuple[str, int], float]:
    """Chance of being personal data by (votes, shape), from two-class expectation-maximisation over the votes."""
    by_votes: dict[str, int] = defaultdict(int)
    for (votes, _), n in counts.items():
        by_votes[votes] += n
    belief = {v: min(0.95, max(0.05, 0.5 + 0.15 * (v.count("+") - v.count("-")))) for v in by_votes}
    for _ in range(rounds):
        share, total = 1.0, 2.0
        says = [{(z, c): 1.0 for z in (0, 1) for c in "+0-"} for _ in range(4)]
        for v, n in by_votes.items():
            share += belief[v] * n
            total += n
            for labeler, c in zip(says, v, strict=True):
                labeler[1, c] += belief[v] * n
                labeler[0, c] += (1 - belief[v]) * n
        prior = share / total
        for v in by_votes:
            odds = math.log(prior / (1 - prior))
            for labeler, c in zip(says, v, strict=True):
                yes, no = (labeler[z, c] / sum(labeler[z, o] for o in "+0-") for z in (1, 0))
                odds += math.log(yes / no)
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return {key: belief[key[0]] for key in counts}


def train(counts: dict[tuple[str, int], int], belief: dict[tuple[str, int], float], rounds: int = 200) -> dict[tuple[str, int], float]:
    """Logistic span classifier over votes and length, fitted to the beliefs; its score of each pattern."""
    weights: dict[str, float] = defaultdict(float)
    features = {key: ["bias", f"len{key[1]}", *[f"{i}{c}" for i, c in enumerate(key[0])]] for key in counts}
    total = sum(counts.values()) or 1
    for _ in range(rounds):
        slope: dict[str, float] = defaultdict(float)
        for key, names in features.items():
            p = 1 / (1 + math.exp(-sum(weights[f] for f in names)))
            for f in names:
                slope[f] += counts[key] / total * (belief[key] - p)
        for f, g in slope.items():
            weights[f] += 2.0 * (g - 1e-4 * weights[f])
    return {key: 1 / (1 + math.exp(-sum(weights[f] for f in names))) for key, names in features.items()}


def _kept(found: DataFrame, spans_col: str | Column, threshold: float) -> Callable[[Column], Column]:
    """What holds of a span that stays: it is a base span, or the classifier trained on all vote patterns of found wants it."""
    counts = found.select(F.explode(spans_col).alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")).collect()
    keep: list[Column] = []
    for kind in range(len(KINDS)):
        mine = {(r["votes"], r["shape"]): r["n"] for r in counts if r["kind"] == kind}
        scores = train(mine, reliabilities(mine))
        keep += [F.lit(f"{kind}{votes}{shape}") for (votes, shape), p in sorted(scores.items()) if p >= threshold]
    kept = F.array(*keep) if keep else F.expr("cast(array() as array<string>)")
    return lambda s: s["base"] | F.array_contains(kept, F.concat(s["kind"].cast("string"), s["votes"], s["shape"].cast("string")))


def find(df: DataFrame, keys: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Spans of personal data in every row's text: the key columns and `spans`, an array of kind, start, end, base, votes, shape.

    Starts and ends are code points, the end exclusive; spans come by kind in the order
    of KINDS, then start; two that start and are of a kind alike cannot be, spans of
    different kinds may overlap unless one is a base span. A null or empty text has no
    spans; a very long one is read whole. Repeated rows and rows with null keys are kept
    as they are. An empty table gives an empty result. Other columns of df are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = settle(df.select(*keys, text.alias("__text")).select(*keys, candidates(F.col("__text")).alias("spans")))
    kept = _kept(found, "spans", threshold)
    return found.withColumn("spans", F.filter("spans", kept))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def mask(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with each span of personal data in text_col replaced by its kind in angle brackets.

    Every other column and every row stays, whatever its name; a null text stays null,
    an empty one empty. Spans of different kinds that overlap are replaced as one, under
    the kind that starts first. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    kept = _kept(df.select(candidates(text).alias("spans")), "spans", threshold)

    def rebuild(found: Column) -> Column:
        """The text anew. A block of spans is cut out of it once, so that a long text with many spans is walked a few times only."""

        def block(acc: Column, b: Column) -> Column:
            own = F.slice(found, b * BLOCK + 1, F.lit(BLOCK))
            last = F.greatest(acc["pos"], F.array_max(F.transform(own, lambda s: s["end"])))
            part = F.struct(own.alias("own"), F.substring(text, (acc["pos"] + 1).cast("int"), (last - acc["pos"]).cast("int")).alias("text"), acc["pos"].alias("from"))

            def walk(x: Column) -> Column:
                def step(a: Column, s: Column) -> Column:
                    gap = F.substring(x["text"], (a["pos"] - x["from"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int"))
                    out = F.when(s["start"] < a["pos"], a["out"]).otherwise(F.array_append(a["out"], F.concat(gap, names[s["kind"]])))
                    return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

                return F.aggregate(x["own"], F.struct(x["from"].alias("pos"), F.array().alias("out")).cast("struct<pos:bigint,out:array<string>>"), step)

            return _let(_let(part, walk), lambda x: F.struct(x["pos"].alias("pos"), F.array_append(acc["out"], F.array_join(x["out"], "")).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / F.lit(BLOCK)).cast("int"))
        done = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("pos"), F.array().alias("out")).cast("struct<pos:bigint,out:array<string>>"), block)
        return _let(done, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, (x["pos"] + 1).cast("int"), F.length(text))))

    by_start = F.array_sort(F.transform(F.filter(candidates(text), kept), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    masked = _let(by_start, lambda found: F.when(F.size(found) == 0, text).otherwise(rebuild(found)))
    result = F.when(F.col(text_col).isNotNull(), masked).cast(df.schema[text_col].dataType)
    return df.select(*[result.alias(c) if c == text_col else F.col(c) for c in df.columns])
