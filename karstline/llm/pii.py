"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators confirm them, and words shortly before
a span raise or lower its score. Kinds, in order:

- email, ip (four parts of at most 255), card (12 to 19 digits passing Luhn) and
  phone (+ and 9 to 15 digits) are the base; what validates is always kept.
- iban: two letters, two digits, up to 30 more, confirmed by remainder 1 modulo 97.
- national: a telephone number that starts with 0, of 9 to 15 digits. Nothing in it
  can be verified, so it counts only if context brings its score to 0.5.
- secret: a word such as token or password, : or =, and a value of 16 characters or more
  that holds a digit and a letter.

Context is whole words within 32 characters on either side, up to the neighbouring matches of the kind.

Positions are code points: the pieces between matches and the matches, both found by
the same expression, give them by their lengths. All repetitions are possessive, which
changes no match since no class overlaps what must follow, and keeps long runs linear.

Null and empty texts have no span. Kinds are searched apart, so spans of different
kinds may overlap; sorted by start, then kind. mask() replaces kind after kind, in
that order, on what is left. Repeated rows give equal rows. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9+])0[0-9][ ()./0-9-]{6,28}[0-9](?![0-9])",
    "secret": r"(?i)\b(?:token|secret|passwd|password|api[_-]?key)[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?[A-Z0-9+/_=-]{16,}+",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind to be possible; spares most texts the search.
HINT = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0", "secret": "instr(text, '=') > 0 or instr(text, ':') > 0"}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "national": 0.3, "secret": 0.8}
_CALL = "phone|telephone|telefon|teléfono|téléphone|tel|call|mobile|handy|móvil|fax|anruf|llama|llame"
CONTEXT = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|karte|kreditkarte|carte|tarjeta|pay|payment",
    "phone": _CALL,
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national": _CALL,
    "secret": "key|auth|login|credentials?",
}
AGAINST = "version|isbn|order|invoice|serial|page"
SPANS = "array<struct<s:int,k:int,e:int,score:double>>"
WINDOW = 32
LEAST = 0.5


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _valid(kind: str, x: str) -> str:
    """SQL predicate on a match. Lengths are tested before any loop over characters."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))"
    if kind == "card":
        doubled = "array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)"
        one = f"int(substring(reverse({_digits(x)}), j, 1))"
        total = f"aggregate(sequence(1, length({_digits(x)})), 0, (t, j) -> t + if(j % 2 = 0, {doubled}[{one}], {one}))"
        return f"if(length({_digits(x)}) between 12 and 19, {total} % 10 = 0, false)"
    if kind == "iban":
        plain = f"replace({x}, ' ', '')"
        turned = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
        step = "if(c between '0' and '9', (t * 10 + int(c)) % 97, (t * 100 + ascii(c) - 55) % 97)"
        return f"if(length({plain}) between 15 and 34, aggregate(split({turned}, ''), 0, (t, c) -> if(c = '', t, {step})) = 1, false)"
    if kind == "secret":
        return f"(rlike({x}, '[:=].*[0-9]') and rlike({x}, '[:=].*[A-Za-z]'))"
    return f"length({_digits(x)}) between 9 and 15"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: str) -> Column:
    found = f"regexp_extract_all(text, {_quoted(PATTERNS[kind])}, 0)"
    hint = HINT.get(kind)
    return F.expr(f"case when text is null{f' or not ({hint})' if hint else ''} then cast(array() as array<string>) else {found} end")


def _near(pieces: str, words: str) -> str:
    """Whether one of the words stands near match i, which lies between pieces i and i + 1."""
    around = f"concat(right({pieces}[i], {WINDOW}), ' ', left({pieces}[i + 1], {WINDOW}))"
    return f"rlike({around}, {_quoted(f'(?iu)' + chr(92) + 'b(?:' + words + ')' + chr(92) + 'b')})"


def _spans(kind: str) -> Column:
    """Valid spans of m_<kind>: array of (s, k, e, score)."""
    m, order = f"m_{kind}", list(PATTERNS).index(kind)
    at = f"a.at + length(g_{kind}[i])"
    score = f"{SCORE[kind]} + if({_near(f'g_{kind}', CONTEXT[kind])}, 0.3, 0.0) - if({_near(f'g_{kind}', AGAINST)}, 0.2, 0.0)"
    span = f"named_struct('s', {at}, 'k', {order}, 'e', {at} + length({m}[i]), 'score', least(1.0D, double({score})))"
    one = f"named_struct('at', {at} + length({m}[i]), 'out', if({_valid(kind, f'{m}[i]')}, concat(a.out, array({span})), a.out))"
    none = f"cast(array() as {SPANS})"
    # Lists grow by concat, which copies them: blocks of about sqrt(n) matches keep the copies of n matches below n * sqrt(n).
    per = f"cast(ceil(sqrt(size({m}))) as int)"
    block = f"aggregate(sequence(b * {per}, least(size({m}), (b + 1) * {per}) - 1), named_struct('at', w.at, 'out', {none}), (a, i) -> {one})"
    joined = f"transform(array({block}), x -> named_struct('at', x.at, 'out', concat(w.out, x.out)))[0]"
    walk = f"aggregate(sequence(0, (size({m}) - 1) div {per}), named_struct('at', 0, 'out', {none}), (w, b) -> {joined}, w -> w.out)"
    return F.expr(f"case when size({m}) = 0 then cast(array() as {SPANS}) else {walk} end")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans, scores."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumns({f"m_{k}": _matches(k) for k in PATTERNS})
    d = d.withColumns({f"g_{k}": F.expr(f"case when size(m_{k}) > 0 then split(text, {_quoted(p)}, -1) end") for k, p in PATTERNS.items()})
    d = d.select("doc_id", *[_spans(k).alias(k) for k in PATTERNS])
    d = d.withColumn("national", F.filter("national", lambda x: x["score"] >= LEAST))
    d = d.withColumn("base", F.array_sort(F.concat(*BASE)))
    d = d.withColumn("every", F.array_sort(F.concat("base", *[k for k in PATTERNS if k not in BASE])))
    return d.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], (F.size("every") - F.size("base")).cast("long").alias("n_more"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"),
        F.array_join(F.transform("every", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """docs with the valid spans of text replaced by <EMAIL>, <IP>, ...; other columns unchanged."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").cast("string").alias("text"))
    for kind, pattern in PATTERNS.items():
        ok = _valid(kind, "x")
        if kind == "national":
            # only with a word near it that speaks for it and none against
            ok = f"({ok} and {_near('g', CONTEXT[kind])} and not {_near('g', AGAINST)})"
        out = out.withColumn("m", _matches(kind))
        out = out.withColumn("g", F.expr(f"case when size(m) > 0 then split(text, {_quoted(pattern)}, -1) end"))
        put = f"array_join(zip_with(g, transform(m, (x, i) -> if({ok}, '<{kind.upper()}>', x)), (a, b) -> concat(a, coalesce(b, ''))), '')"
        out = out.select("__doc", F.expr(f"case when size(m) = 0 then text else {put} end").alias("text"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
