r"""Personal data by patterns, checksums and context, in SQL functions alone.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm
them, words near a span adjust its score. Secrets (keys, tokens, passwords) are
spans too: what is assigned to a name of a secret, or has the form of a known
issuer's keys, and mixes letters and digits. All patterns are linear in the
text: quantifiers that can't match otherwise are possessive, and a look-behind
keeps a run of characters from being tried from each of its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of the base, in order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "imei", "secret")

#: Each pattern equals the plain one named beside it on every text that can pass its validator.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 digits or more
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the first four characters; IBAN_END finds where it ends
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "imei": r"(?<![0-9])[0-9]{15}(?![0-9])",
    # an assignment, the span being its value, or a key of a known form
    "secret": r"(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Pp][Ww][Dd]|[Kk][Ee][Yy])[\"']?[\x20\t]*(?:=>|:=|=|:)[\x20\t]*[\"']?[A-Za-z0-9+/_.~-]{12,}={0,2}"
    r"|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN[\x20][A-Z\x20]*PRIVATE[\x20]KEY-----[A-Za-z0-9+/=\s]*-----END[\x20][A-Z\x20]*PRIVATE[\x20]KEY-----",
}

#: The part of a secret's match that is the secret.
SECRET_VALUE = r"(?s)-----BEGIN.*|[A-Za-z0-9+/_.~-]{12,}={0,2}$"

#: Texts without any of these, in lower case, have no span of the kind.
NEEDS = {
    "email": ("@",), "ip": (".",), "phone": ("+",), "ssn": ("-",),
    "secret": ("token", "secret", "passw", "pwd", "key", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "k_live_", "k_test_", "aiza", "eyj"),
}

#: Length of a country's IBANs; those of other codes end where mod 97 holds, the last such place.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Words near a span that raise its score.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|mail|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|mastercard)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|tax)\b",
    "imei": r"(?i)\b(?:imei|device|handset)\b",
    "secret": r"(?i)\b(?:secret|token|password|key|credential|bearer)\b",
}
#: Characters before and after a span in which context words count; score of a confirmed span, what context adds, the least score kept.
WINDOW, CONFIRMED, CONTEXT_ADDS = 40, {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "imei": 0.3, "secret": 0.7}, 0.3
LEAST_SCORE = 0.5

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + case when (length(d) - i) % 2 = 0 then cast(substring(d, i, 1) as int) "
    "when cast(substring(d, i, 1) as int) < 5 then 2 * cast(substring(d, i, 1) as int) else 2 * cast(substring(d, i, 1) as int) - 9 end) % 10 = 0"
)
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_MOD97 = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> case when substring(d, i, 1) rlike '[0-9]' then (s * 10 + cast(substring(d, i, 1) as int)) % 97 "
    "else (s * 100 + ascii(substring(d, i, 1)) - 55) % 97 end) = 1"
)


def _with(value: str, body: str, name: str = "d") -> str:
    """SQL with a name bound to ``value``."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, _) -> {name}, {name} -> {body})"


#: SQL over ``m``, the text of a span.
VALID = {
    "email": "true",
    "ip": f"m rlike '^{_OCTET}([.]{_OCTET}){{3}}$'",
    "card": _with(_DIGITS, f"length(d) between 13 and 19 and {_LUHN}"),
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": _with("concat(substring(regexp_replace(m, ' ', ''), 5), substring(m, 1, 4))", f"length(d) between 15 and 34 and {_MOD97}"),
    "ssn": "m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'",
    "imei": _with("m", _LUHN),
    "secret": "m rlike '[0-9]' and m rlike '[A-Za-z]'",
}

def _iban_end() -> str:
    """SQL over ``w``, a text from an IBAN's start on: the IBAN, or null if there is none."""
    candidate = "regexp_extract(w, '^[A-Z]{2}[0-9]{2}(?:[ ]?+[A-Z0-9]){11,30}+', 0)"
    ends = f"if(length(c) < 15, cast(array() as array<int>), filter(sequence(15, length(c)), e -> not substring(w, e + 1, 1) rlike '[A-Za-z0-9]' and substring(w, e, 1) <> ' '))"
    lengths = "map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items()) + ")"
    fits = f"length(replace(m, ' ', '')) = coalesce(try_element_at({lengths}, substring(m, 1, 2)), length(replace(m, ' ', '')))"
    found_ = f"filter(transform({ends}, e -> substring(w, 1, e)), m -> {fits} and {VALID['iban']})"
    return _with(candidate, f"try_element_at({found_}, -1)", "c")


IBAN_END = _iban_end()
#: Characters from an IBAN's start within which it and the character after it lie.
_IBAN_ROOM = 68

_SPAN = "array<struct<kind:string,first:int,last:int,score:double>>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ahead(i: str, room: int) -> str:
    """SQL for the first ``room`` characters after match ``i``, counted from 1; a match has four characters or more."""
    return f"left(array_join(transform(sequence({i}, least({i} + {room // 4}, size(ms))), j -> concat(left(ps[j], {room}), coalesce(get(ms, j), ''))), ''), {room})"


def found(kind: str, text: str) -> str:
    """SQL for the confirmed spans of one kind: pieces between matches and the matches give the offsets in code points.

    ``before`` carries the last WINDOW characters before each match, so context
    reaches over other matches of the kind, and the work stays linear.
    """
    pattern = _sql(PATTERNS[kind])
    span, first = "ms[i - 1]", "acc.at + length(ps[i - 1])"
    if kind == "iban":
        span = _with(f"concat(ms[i - 1], {_ahead('i', _IBAN_ROOM - 4)})", IBAN_END, "w")
    elif kind == "secret":
        span, first = f"regexp_extract(ms[i - 1], {_sql(SECRET_VALUE)}, 0)", "acc.at + length(ps[i - 1]) + length(ms[i - 1]) - length(m)"
    valid = VALID[kind] if kind != "iban" else "m is not null and (size(acc.out) = 0 or element_at(acc.out, -1).last <= acc.at + length(ps[i - 1]))"
    after = _ahead("i", WINDOW) if kind != "iban" else f"substring({_ahead('i', WINDOW + _IBAN_ROOM)}, length(m) - 3, {WINDOW})"
    fold = (
        "aggregate(sequence(1, size(ms)), named_struct('at', 0, 'before', '', 'out', cast(array() as {span_type})), (acc, i) -> "
        "named_struct('at', acc.at + length(ps[i - 1]) + length(ms[i - 1]), 'before', right(concat(acc.before, right(ps[i - 1], {window}), right(ms[i - 1], {window})), {window}), "
        "'out', aggregate(cast(array() as array<int>), {span}, (m, _) -> m, m -> "
        "if({valid}, concat(acc.out, array(named_struct('kind', {kind}, 'first', {first}, 'last', {first} + length(m), "
        "'score', cast({sure} as double) + if(right(concat(acc.before, right(ps[i - 1], {window})), {window}) rlike {context} or {after} rlike {context}, {adds}D, 0D)))), acc.out))), acc -> acc.out)"
    ).format(span_type=_SPAN, span=span, first=first, valid=valid, kind=_sql(kind), sure=CONFIRMED[kind], window=WINDOW, context=_sql(CONTEXT[kind]), after=after, adds=CONTEXT_ADDS)
    spans = (
        f"aggregate(cast(array() as array<int>), regexp_extract_all({text}, {pattern}, 0), (ms, _) -> ms, ms -> if(size(ms) = 0, cast(array() as {_SPAN}), "
        f"aggregate(cast(array() as array<int>), split({text}, {pattern}, -1), (ps, _) -> ps, ps -> {fold})))"
    )
    if kind in NEEDS:
        some = " or ".join(f"contains(t, {_sql(x)})" for x in NEEDS[kind])
        spans = f"if({_with(text if len(NEEDS[kind]) == 1 else f'lower({text})', some, 't')}, {spans}, cast(array() as {_SPAN}))"
    return spans if kind in BASE else f"filter({spans}, x -> x.score >= {LEAST_SCORE})"


def spans(text: str) -> Column:
    """Spans of a text, given as SQL, by kind as in KINDS, then start.

    The added kinds count only where their score, with context, reaches
    LEAST_SCORE; base kinds count once confirmed. Offsets are in code points, the
    end excluded.
    """
    return F.concat(*(F.expr(found(k, text)) for k in KINDS))


def with_spans(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """Every column of ``docs``, with ``name`` (replaced if present): array of kind, first, last, score.

    A null text counts as empty. Repeated rows stay; an empty table gives an
    empty result.
    """
    return docs.withColumn(name, spans(f"coalesce(`{text}`, '')"))


def joined(array: str) -> str:
    return f"array_join(transform({array}, x -> concat(x.kind, ':', x.first, ':', x.last)), ',')"


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one, of the first's kind. Null stays null."""
    name = "__" + "_".join(["pii", *docs.columns])  # no column has this name
    merged = (
        f"aggregate(array_sort(transform(`{name}`, x -> named_struct('first', x.first, 'last', x.last, 'kind', x.kind))), "
        "cast(array() as array<struct<first:int,last:int,kind:string>>), (acc, x) -> "
        "if(size(acc) > 0 and acc[size(acc) - 1].last > x.first, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', acc[size(acc) - 1].first, 'last', greatest(acc[size(acc) - 1].last, x.last), 'kind', acc[size(acc) - 1].kind))), "
        "concat(acc, array(x))))"
    )
    pieces = f"aggregate(cast(array() as array<int>), {merged}, (s, _) -> s, s -> concat(transform(s, (x, i) -> concat(substring(`{text}`, if(i = 0, 0, s[i - 1].last) + 1, x.first - if(i = 0, 0, s[i - 1].last)), '[', upper(x.kind), ']')), array(substring(`{text}`, s[size(s) - 1].last + 1))))"
    clean = F.expr(f"if(size(`{name}`) = 0, `{text}`, array_join({pieces}, ''))")
    return with_spans(docs, text, name).withColumn(text, clean).select(*(F.col(f"`{c}`") for c in docs.columns))
