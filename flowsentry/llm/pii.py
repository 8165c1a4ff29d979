"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

Only built-in functions: matches come from ``regexp_extract_all``, the text between them from
``split`` with the same pattern, and places from their lengths. The patterns find what plain
leftmost matching finds, written so that no run of characters is walked more than once:
possessive runs, and starts only where a run starts or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Context words by kind (fixed values): they raise a span's score when they stand nearby.
CONTEXT = {
    "email": "mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|server|host|address|adresse|login",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|llame",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "secret": "login|credential|auth",
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without this substring has no match; "" if there is no such substring
    score: float  # before context
    base: bool = True


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = "A-Za-z0-9._%+-"
_KEYS = "token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key"

KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "", 0.7),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.5),
    # Zero-width, so that a start within another proposal is seen; takes one sign more than an account has.
    Kind("iban", r"(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,31}+))(?<=(?:^|[^A-Za-z0-9])[A-Za-z]{0,30})", "", 0.8, base=False),
    Kind("ssn", r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++", "-", 0.3, base=False),
    # What a key word and a sign assign; the one sign ahead is looked at first, as it rules most places out.
    Kind("secret", rf"""(?<=[=: "'])(?<=(?i:{_KEYS})["']? {{0,2}}[=:] {{0,2}}["']?)[A-Za-z0-9+/_-]{{16,}}+""", "", 0.8, base=False),
)
BOOST, REACH, LEAST = 0.3, 40, 0.6
GROUP = 128

# Signs of an account number by country (the IBAN registry); others may have 15 to 34.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def luhn(digits: Column) -> Column:
    """Is the digit string's Luhn sum a multiple of ten?"""
    size = F.length(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, size - place, F.lit(1)).cast("int") * (1 + place % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Does the account number, its first four signs moved to the end, leave 1 modulo 97?"""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        value = F.when(char <= "9", char.cast("int")).otherwise(F.ascii(char) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The checksum or count that a match of the kind must pass."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        plain = F.replace(value, F.lit(" "))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    if kind == "secret":  # a word that only looks like one has no digit
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "ssn":
        return value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return F.lit(True)


def _account(ahead_of: Column) -> Column:
    """The account number that the signs proposed at a place begin with; null if none is confirmed.

    It ends at a word border: after its country's number of signs, else where the run of words ends,
    else (countries without a number of signs) as late as mod 97 allows.
    """
    country = F.left(ahead_of, F.lit(2))
    signs = F.coalesce(*[F.when(country.isin(names.split()), n) for n, names in IBAN_SIGNS.items()], F.lit(0))
    words = F.split(ahead_of, " ")
    # Where the proposal was cut off, its last word may go on, so no account ends with it.
    cut = F.length(F.replace(ahead_of, F.lit(" "))) == 35
    whole = F.size(words)

    def ending(k: Column) -> Column:
        return F.array_join(F.slice(words, 1, k), " ")

    def possible(k: Column) -> Column:
        number = F.length(F.array_join(F.slice(words, 1, k), ""))
        return ((signs == 0) | (number == signs) | (k == whole)) & ~(cut & (k == whole)) & confirmed("iban", ending(k))

    ends = F.filter(F.sequence(F.lit(1), whole), possible)
    exact = F.filter(ends, lambda k: F.length(F.array_join(F.slice(words, 1, k), "")) == signs)
    return ending(F.coalesce(F.array_max(exact), F.array_max(ends)))


def _accounts(kind: Kind, text: Column, found: Column) -> Column:
    """As ``_spans`` for a pattern of no width: of proposals that overlap, the first confirmed one."""
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    pieces = F.split(text, kind.pattern, -1)
    # A split leaves out the empty text ahead of a match at the very beginning.
    pieces = F.when(F.size(pieces) > F.size(found), pieces).otherwise(F.concat(F.array(F.lit("")), pieces))
    both = F.arrays_zip(found.alias("value"), F.slice(pieces, 1, F.size(found)).alias("ahead"))
    words = rf"(?i)\b(?:{CONTEXT[kind.name]})"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["ahead"])
        value = F.when(start >= state["end"], _account(x["value"]))
        end = start + F.length(value)
        begin = F.greatest(state["end"], start - REACH)
        near = (F.substring(text, begin + 1, start - begin).rlike(words)
                | F.substring(text, end + 1, F.lit(REACH)).rlike(words))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, BOOST).otherwise(0.0))
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(
            start.alias("at"), F.coalesce(end, state["end"]).alias("end"),
            F.when(value.isNotNull() & (score >= LEAST), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(both, begin, step, lambda state: state["out"])).otherwise(empty)


def _spans(kind: Kind, text: Column, found: Column) -> Column:
    """All confirmed matches of the kind as (kind, start, end, score), in order of start."""
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    between = F.split(text, kind.pattern, -1)
    both = F.arrays_zip(found.alias("value"), between.alias("ahead"), F.slice(between, 2, F.size(found) + 1).alias("behind"))
    words = rf"(?i)\b(?:{CONTEXT[kind.name]})"

    def step(state: Column, x: Column) -> Column:
        value, ahead, behind = x["value"], x["ahead"], x["behind"]
        start = state["at"] + F.length(ahead)
        end = start + F.length(value)
        near = F.right(ahead, F.lit(REACH)).rlike(words) | F.left(behind, F.lit(REACH)).rlike(words)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, BOOST).otherwise(0.0))
        keep = confirmed(kind.name, value) if kind.base else confirmed(kind.name, value) & (score >= LEAST)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(keep, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    # A list that grows is copied at every step, so matches are walked in groups that know where they start.
    # Between n matches lie n + 1 texts; the last of them follows no match of its own.
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / GROUP).cast("int")), lambda g: F.slice(
        both, g * GROUP + 1, F.least(F.lit(GROUP), F.size(found) - g * GROUP)))

    def length(group: Column) -> Column:
        return F.aggregate(group, F.lit(0), lambda total, x: total + F.length(x["value"]) + F.length(x["ahead"]))

    starts = F.aggregate(groups, F.array(F.lit(0)), lambda all_, g: F.array_append(all_, F.element_at(all_, -1) + length(g)))
    placed = F.arrays_zip(groups.alias("group"), F.slice(starts, 1, F.size(groups)).alias("start"))

    def walked(x: Column) -> Column:
        begin = F.struct(x["start"].alias("at"), empty.alias("out"))
        return F.aggregate(x["group"], begin, step, lambda state: state["out"])

    return F.when(F.size(found) > 0, F.flatten(F.transform(placed, walked))).otherwise(empty)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, spans): every confirmed span of every whole text, by kind and start.

    Null and empty texts give an empty list; repeated rows and equal ids give a row each; other
    columns are not read, so their names do not matter. The base kinds keep every confirmed match;
    iban, ssn and secret need a score of LEAST or more. A secret is a run of 16 letters and digits or more
    that a key word such as ``token`` assigns. No shuffle, no Python.
    """
    text = fresh("text", docs.select(id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    columns = {}
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(1 if kind.name == "iban" else 0))
        if kind.hint:
            found = F.when(F.contains(F.col(text), F.lit(kind.hint)), found).otherwise(F.expr("cast(array() as array<string>)"))
        columns[f"found_{kind.name}"] = found
    rows = rows.select("doc_id", text, *(c.alias(name) for name, c in columns.items()))
    spans = [(_accounts if kind.name == "iban" else _spans)(kind, F.col(text), F.col(f"found_{kind.name}")) for kind in KINDS]
    return rows.select("doc_id", F.concat(*spans).alias("spans"))


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same table with every proposed match that its check confirms replaced by ``[kind]``.

    All columns stay. A null text stays null. Kinds are replaced in their listed order.
    """
    out = F.col(text_col)
    for kind in KINDS:
        if not kind.base:
            continue
        out = _masked(kind, out)
    return docs.withColumn(text_col, out)


def _masked(kind: Kind, text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda v: confirmed(kind.name, v))
    return F.aggregate(F.array_distinct(found), text, lambda rest, v: F.replace(rest, v, F.lit(f"[{kind.name}]")))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans as text, and their number."""
    base = [kind.name for kind in KINDS if kind.base]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _sql_kind(name: str, pattern: str, keep: str, score: float | None = None, skip: str = "0") -> str:
    """Common table expressions giving (doc_id, place, kind, start, stop) of one kind; ``skip`` says how many
    signs of a match lie ahead of the span."""
    near = f"(?i)\\b(?:{CONTEXT[name]})"
    more = "" if score is None else (
        f" and {score} + case when regexp_matches(right(ahead, {REACH}), '{near}') or "
        f"regexp_matches(left(behind, {REACH}), '{near}') then {BOOST} else 0.0 end >= {LEAST}")
    return f"""
    {name}_all as (
      select n, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p
      from texts where regexp_matches(t, '{pattern}')),
    {name}_each as (
      select n, unnest(range(1, len(m) + 1)) as i, unnest(m) as v,
             unnest(p[1:len(m)]) as ahead, unnest(p[2:len(m) + 1]) as behind from {name}_all),
    {name}_place as (
      select *, sum(length(ahead) + length(v)) over (partition by n order by i) - length(v) as start from {name}_each),
    {name}_kept as (
      select n, '{name}' as kind, start, concat_ws(':', '{name}', (start + {skip})::bigint, (start + length(v))::bigint) as s
      from {name}_place where {keep}{more})"""


_LUHN = """length(regexp_replace(v, '[ -]', '', 'g')) between 13 and 19 and
      list_sum(list_transform(range(0, length(regexp_replace(v, '[ -]', '', 'g'))), lambda k:
        case when k % 2 = 0 then substr(reverse(regexp_replace(v, '[ -]', '', 'g')), k + 1, 1)::int
             when substr(reverse(regexp_replace(v, '[ -]', '', 'g')), k + 1, 1)::int > 4
             then substr(reverse(regexp_replace(v, '[ -]', '', 'g')), k + 1, 1)::int * 2 - 9
             else substr(reverse(regexp_replace(v, '[ -]', '', 'g')), k + 1, 1)::int * 2 end)) % 10 = 0"""
_MOD97 = """length(replace(v, ' ', '')) between 15 and 34 and
      list_reduce(list_prepend(0, list_transform(string_split(
          substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''),
          lambda c: case when c <= '9' then ascii(c) - 48 else ascii(c) - 55 end)),
        lambda a, b: (a * case when b > 9 then 100 else 10 end + b) % 97) = 1"""

_SECRET = "regexp_extract(v, '[A-Za-z0-9+/_-]{16,}$')"

ORACLE = "with texts as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents)," + ",".join([
    _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _sql_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
              "list_max(list_transform(string_split(v, '.'), lambda x: x::hugeint)) <= 255"),
    _sql_kind("card", r"[0-9](?:[ -]?[0-9])+", _LUHN),
    _sql_kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) between 9 and 15"),
    _sql_kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+", _MOD97, 0.8),
    _sql_kind("ssn", r"[0-9]+-[0-9]+-[0-9]+", "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", 0.3),
    _sql_kind("secret", rf"""(?i:{_KEYS})["'']? {{0,2}}[=:] {{0,2}}["'']?[A-Za-z0-9+/_-]{{16,}}""",
              f"regexp_matches({_SECRET}, '[0-9]') and regexp_matches({_SECRET}, '[A-Za-z]')", skip=f"length(v) - length({_SECRET})"),
]) + """,
    spans as (
      select * from email_kept union all select * from ip_kept union all select * from card_kept
      union all select * from phone_kept union all select * from iban_kept union all select * from ssn_kept
      union all select * from secret_kept),
    ranked as (select *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn', 'secret'], kind) as k from spans),
    joined as (
      select n, string_agg(s, ',' order by k, start) as spans,
             string_agg(s, ',' order by k, start) filter (k <= 4) as base,
             count(*) as n_spans, count(*) filter (k = 1) as n_email, count(*) filter (k = 2) as n_ip,
             count(*) filter (k = 3) as n_card, count(*) filter (k = 4) as n_phone
      from ranked group by n)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
       coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
from texts left join joined using (n)
"""
