"""Format-preserving pseudonyms for personal data and secrets (operator 3), in SQL expressions only.

Numbers and dates are validated and then permuted within their format by a keyed Feistel network, so that equal values
get equal pseudonyms everywhere and different ones stay different: digits of telephone and identity numbers; card
numbers but for the first and the check digit, which is computed anew; the digits of bank accounts (IBAN), with new check
digits; IPv4 addresses; dates within the 400 years from 1800, with the month first where that alone makes them a date.
Addresses of e-mail, IPv6 addresses, tokens and secrets have no such format: they become keyed digests of their kind.

The halves of a network are numbers modulo a and b with a * b the size of the format, so it is a permutation of exactly
that format: (63, 2319) for the 146,097 days of 400 years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY = "corvane example key"
ROUNDS = 8

_LOCAL = r"\p{L}\p{N}._%+\-"
#: The name of a secret; its value, of at least 8 characters, or 4 with a digit, reaches to a quote or white space, without stops and brackets at its end.
_NAMED = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key))[\"']? {0,3}[=:] {0,3}"
_VALUE = r"[^\s\p{Z}\x85\"']"
_LAST = rf"(?![.,;:)\]}}>]){_VALUE}"
# How tokens begin that some services issue.
_ISSUED = "(?:gh[pousr]_|github_pat_|glpat-|sk-|xox[abeoprs]-|AIza)"
#: Kinds in order of precedence, as Java patterns without capturing groups.
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)++",
    "secret": rf"{_NAMED}(?:\"[^\"\r\n]{{4,}}+\"|'[^'\r\n]{{4,}}+'|[\"']?(?=(?:{_VALUE}{{7,}}{_LAST}|{_VALUE}{{0,7}}\d)){_VALUE}{{3,}}{_LAST}[\"']?)",
    "token": rf"(?<![A-Za-z0-9_])(?:{_ISSUED}[A-Za-z0-9_\-]{{20,}}|eyJ[A-Za-z0-9_\-]{{8,}}\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "hex": r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\w:])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d/.\-])(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[/.\-]\d)",
    "identity": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{13,19}(?!\d)|\d{4}(?: \d{4}){3}(?!\d)(?: \d{4}(?![\w@%+]|[.\-/]\w))*+|\d{4}(?:-\d{4}){3}(?!\d)(?:-\d{4}(?![\w@%+]|[./]\w))*+|\d{4}[ \-]\d{6}[ \-]\d{5}(?!\d))",
}
#: Telephone numbers of one shape. Those of a country code and free groups have 7 to 15 digits; once they have 7, no group is taken that begins another value.
_SHAPES = r"(?<![\w+])\+(?:1[ .\-]?\(?\d{3}\)?|\d{1,3}[ .\-]?\(\d{3}\))[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
#: National ones, from a zero on; no part of a longer row of groups.
_NATIONAL = r"(?<![\w+.\-/]|\d[ \-])0(?:\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4}|\d{3,4}[ \-]\d{5,8})(?![\w\-]|[./ ]\d)"
#: 7 to 15 digits behind, written out: Java looks behind only where the length has an obvious end.
_DIGITS = r"(?<=\+" + r"[ .()\-]{0,2}\d" * 7 + r"(?:[ .()\-]{0,2}\d)?" * 8 + "%s)"
#: In a row of groups of four, cards begin where four or a multiple of it are left.
_ROW = r"\d{4}(?:-\d{4}){3}(?!\d)(?:(?:-\d{4}(?![\w@%+]|[./]\w)){4})*+(?!-\d{4}(?![\w@%+]|[./]\w))"
_CARDS = rf"(?<!\d)(?:\d{{13,19}}(?!\d)|{_ROW}|{_ROW.replace('-', ' ').replace('[./]', '[./-]')}|\d{{4}}[ \-]\d{{6}}[ \-]\d{{5}}(?!\d))"
_OTHER = "|".join(f"(?:{p})" for p in [*(PATTERNS | {"card": _CARDS}).values(), _SHAPES])
_GROUPS = rf"(?<![\w+])\+\d{{1,3}}[ .\-]?\(?\d{{2,4}}\)?(?:[ .\-]?(?!{_DIGITS % "[ .-]"}(?:{_OTHER}))\d{{2,4}}){{1,4}}(?!\d){_DIGITS % ""}"
PATTERNS["phone"] = f"{_SHAPES}|{_GROUPS}|{_NATIONAL}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(kind: str, m: str) -> str:
    return f"{m} rlike {_sql(f'^(?:{PATTERNS[kind]})$')}"


def _round(key: str, tweak: str, k: str, half: str) -> str:
    """A keyed function of one half: 60 bits."""
    return f"cast(conv(substring(sha2(concat_ws('|', {_sql(key)}, {_sql(tweak)}, {k}, {half}), 256), 1, 15), 16, 10) as bigint)"


def feistel(left: str, right: str, a: str, b: str, key: str, tweak: str) -> str:
    """SQL: struct l, r, the permuted pair of left modulo a and right modulo b."""
    pair = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    even = f"named_struct('l', (s.l + {_round(key, tweak, 'k', 's.r')}) % cast({a} as bigint), 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', (s.r + {_round(key, tweak, 'k', 's.l')}) % cast({b} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {pair}, (s, k) -> if(k % 2 = 0, {even}, {odd}))"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with the value under a name, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def permuted_digits(d: str, key: str, tweak: str) -> str:
    """SQL: a string of 2 to 20 digits permuted among those of its length."""
    u, v = "(length(d) div 2)", "(length(d) - length(d) div 2)"
    network = feistel(f"substring(d, 1, {u})", f"substring(d, {u} + 1)", f"pow(10, {u})", f"pow(10, {v})", key, tweak)
    put = f"concat(lpad(cast(f.l as string), {u}, '0'), lpad(cast(f.r as string), {v}, '0'))"
    return _let(d, "d", _let(network, "f", put))


def _into(m: str, digits: str) -> str:
    """SQL: the digits in place of those of m, all else kept."""
    step = "if(c between '0' and '9', named_struct('o', concat(z.o, substring(w, z.n, 1)), 'n', z.n + 1), named_struct('o', concat(z.o, c), 'n', z.n))"
    return _let(digits, "w", f"aggregate(split({m}, ''), named_struct('o', '', 'n', 1), (z, c) -> {step}, z -> z.o)")


def _spaced(m: str, new: str) -> str:
    """SQL: the characters of new with the spaces of m."""
    step = "if(c = ' ', named_struct('o', concat(z.o, c), 'n', z.n), named_struct('o', concat(z.o, substring(w, z.n, 1)), 'n', z.n + 1))"
    return _let(new, "w", f"aggregate(split({m}, ''), named_struct('o', '', 'n', 1), (z, c) -> {step}, z -> z.o)")


def _mod97(text: str) -> str:
    """SQL: the rest by 97 of digits and capitals, which count as two digits from 10 for A on."""
    return f"aggregate(split({text}, ''), 0L, (t, c) -> if(c between '0' and '9', t * 10 + cast(c as int), t * 100 + ascii(c) - 55) % 97)"


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of digits to which a check digit will be added on the right."""
    at = "cast(x as int) * if(i % 2 = 0, 2, 1)"
    return f"aggregate(transform(split(reverse({digits}), ''), (x, i) -> {at}), cast(0 as bigint), (t, y) -> t + y div 10 + y % 10)"


def _date(m: str, key: str) -> str:
    """SQL: a date of ten characters permuted; as it is if it is none."""
    day = f"coalesce(try_cast({m} as date), try_cast(concat_ws('-', substring({m}, 7, 4), substring({m}, 4, 2), substring({m}, 1, 2)) as date))"
    moved = feistel("g div 2319", "g % 2319", "63", "2319", key, "date")
    iso = f"date_format(date_add(date'1800-01-01', cast(f.l * 2319 + f.r as int)), 'yyyy-MM-dd')"
    written = _let(iso, "q", f"if(substring({m}, 5, 1) = '-', q, concat_ws(substring({m}, 3, 1), substring(q, 9, 2), substring(q, 6, 2), substring(q, 1, 4)))")
    # Written with the month first only days after the 12th tell: they have numbers g of their own, and month k those from 12 * k fewer than its days before on.
    tells = f"try_cast(concat_ws('-', substring({m}, 7, 4), substring({m}, 1, 2), substring({m}, 4, 2)) as date)"
    number = _let(tells, "t", "datediff(t, date'1800-01-01') - 12 * ((year(t) - 1800) * 12 + month(t))")
    late = feistel("g div 9833", "g % 9833", "9", "9833", key, "late date")
    first = "datediff(add_months(date'1800-01-01', k), date'1800-01-01') - 12 * k"
    k = f"array_max(filter(sequence(int(p * 4800 div 88497) - 1, int(p * 4800 div 88497) + 1), k -> {first} <= p))"
    us = f"date_format(date_add(add_months(date'1800-01-01', k), int(p - ({first}) + 12)), {_sql('MM-dd-yyyy')})"
    us = _let(f"{late}", "f", _let("f.l * 9833 + f.r", "p", _let(k, "k", f"replace({us}, '-', substring({m}, 3, 1))")))
    us = _let(number, "g", f"if(g is null or g < 0 or g >= 88497, {m}, {us})")
    return _let(f"datediff({day}, date'1800-01-01')", "g", f"if(g is null, {us}, if(g < 0 or g >= 146097, {m}, {_let(moved, 'f', written)}))")


def pseudonym(m: str, key: str = KEY) -> str:
    """SQL: what stands for a match of ANY. A number or date that does not validate stays as it is."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = f"concat('u', substring(sha2(concat_ws('|', {_sql(key)}, 'email', lower({m})), 256), 1, 16), '@mail.invalid')"
    name = f"regexp_extract({m}, {_sql(_NAMED + chr(91) + chr(34) + chr(39) + chr(93) + '?')}, 0)"
    quoted = f"if(endswith({m}, '\"') or endswith({m}, '\\''), 1, 0)"
    value = f"substring({m}, length(n) + 1, length({m}) - length(n) - {quoted})"
    digest = f"concat(sha2(concat_ws('|', {_sql(key)}, 'secret', v), 512), sha2(concat_ws('|', {_sql(key)}, 'more', v), 512))"
    fresh = f"substring(repeat({digest}, int(length(v) div 256 + 1)), 1, length(v))"
    secret = _let(name, "n", _let(value, "v", f"concat(n, {fresh}, substring({m}, length(n) + length(v) + 1))"))
    access = f"concat('AKIA', upper(substring(sha2(concat_ws('|', {_sql(key)}, 'access', {m}), 256), 1, 16)))"
    hexes = f"substring(repeat(sha2(concat_ws('|', {_sql(key)}, 'hex', {m}), 256), int(length({m}) div 64 + 1)), 1, length({m}))"
    issued = f"regexp_extract({m}, {_sql(f'^(?:{_ISSUED}|eyJ)')}, 0)"
    token = _let(issued, "n", f"concat(n, substring(repeat(sha2(concat_ws('|', {_sql(key)}, 'token', {m}), 256), int(length({m}) div 64 + 1)), 1, length({m}) - length(n)))")
    # The digits of an account are permuted in their places; its two check digits are those of the new one.
    rest = "substring(e, 5)"
    account = _let(f"regexp_replace({rest}, '[^0-9]', '')", "d", f"if(length(d) < 2, {rest}, {_into(rest, permuted_digits('d', key, 'iban'))})")
    checked = _let(account, "y", f"concat(substring(e, 1, 2), lpad(cast(98 - {_mod97("concat(y, substring(e, 1, 2), '00')")} as string), 2, '0'), y)")
    iban = _let(f"replace({m}, ' ', '')", "e", f"if({_mod97('concat(substring(e, 5), substring(e, 1, 4))')} = 1, {_spaced(m, checked)}, {m})")
    groups = ", ".join(f"substring(h, {4 * i + 1}, 4)" for i in range(6))
    ipv6 = _let(f"sha2(concat_ws('|', {_sql(key)}, 'ipv6', lower({m})), 256)", "h", f"concat_ws(':', '2001:db8', {groups})")
    octets = f"transform(split({m}, '[.]'), x -> cast(x as bigint))"
    network = feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key, "ip")
    ip = _let(octets, "o", f"if(exists(o, x -> x > 255), {m}, {_let(network, 'f', "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")})")
    # Days and months of one digit: as with a zero before them, which goes again if the date is changed.
    padded = "concat(lpad(p[0], 2, '0'), substring(c, length(p[0]) + 1, 1), lpad(p[1], 2, '0'), substring(c, length(p[0]) + 1, 1), p[2])"
    short = _let(m, "c", _let("split(c, '[/.]')", "p", _let(padded, "o", _let(_date("o", key), "r", "if(r = o, c, regexp_replace(r, '(^|[/.])0', '$1'))"))))
    date = f"if(length({m}) = 10, {_date(m, key)}, {short})"
    country = f"regexp_extract({m}, {_sql(r'^(?:\+\d{1,3}(?=[ .(\-])|0(?=\d))')}, 0)"
    local = f"substring({m}, length(h) + 1)"
    phone = _let(country, "h", f"concat(h, {_into(local, permuted_digits(f'regexp_replace({local}, {_sql("[^0-9]")}, {_sql("")})', key, 'number'))})")
    # No part of an identity number is all zeros and the first is not 666: 998 * 99 * 9999 numbers, permuted among themselves.
    parts = f"transform(split({m}, '-'), x -> cast(x as int))"
    one = feistel("(o[0] - if(o[0] > 666, 2, 1)) * 99 + o[1] - 1", "o[2] - 1", "998 * 99", "9999", key, "identity")
    put = "concat_ws('-', lpad(cast(f.l div 99 + if(f.l div 99 >= 665, 2, 1) as string), 3, '0'), lpad(cast(f.l % 99 + 1 as string), 2, '0'), lpad(cast(f.r + 1 as string), 4, '0'))"
    identity = _let(parts, "o", f"if(o[0] = 0 or o[0] = 666 or o[1] = 0 or o[2] = 0, {m}, {_let(one, 'f', put)})")
    body = f"concat(substring(e, 1, 1), {permuted_digits('substring(e, 2, length(e) - 2)', key, 'card')})"
    new = _let(body, "y", f"concat(y, cast((10 - {_luhn('y')} % 10) % 10 as string))")
    valid = f"({_luhn('substring(e, 1, length(e) - 1)')} + cast(substring(e, -1, 1) as int)) % 10 = 0"
    card = _let(digits, "e", f"if({valid}, {_into(m, new)}, {m})")
    # In a row of more than four groups of four, the first four that validate are a card; the search goes on after them.
    four, one = "substring(r.o, -19)", "named_struct('o', concat(r.o, g), 'n', r.n + 1)"
    shut = f"if(r.n < 4, r, {_let(_let(f"regexp_replace({four}, '[^0-9]', '')", 'e', f"if({valid}, {_into(four, new)}, '')"), 't', "if(t = '', r, named_struct('o', concat(substring(r.o, 1, length(r.o) - 19), t), 'n', 0))")})"
    row = f"aggregate(regexp_extract_all({m}, '[ -]?[0-9]{{4}}', 0), named_struct('o', '', 'n', 0), (s, g) -> {_let(one.replace('r.', 's.'), 'r', shut)}, s -> s.o)"
    card = f"if(length({m}) > 19 and {m} rlike '[ -]', {row}, {card})"
    return f"""case when {_is("secret", m)} then {secret} when instr({m}, '@') > 0 then {email} when {_is("access_key", m)} then {access} when {_is("token", m)} then {token}
        when {_is("iban", m)} then {iban} when {_is("ipv6", m)} then {ipv6} when {_is("ip", m)} then {ip} when {_is("date", m)} then {date} when {_is("identity", m)} then {identity}
        when {m} like '+%' or {_is("phone", m)} then {phone} when {_is("card", m)} then {card} when {_is("hex", m)} then {hexes} else {m} end"""


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, count: str | None = "n_replaced") -> DataFrame:
    """docs with the text replaced and, if named, a column that counts the changed spans.

    Null texts stay null and empty ones empty (0); repeated rows are changed alike; texts of any length are changed
    whole; all other columns stay, but one of the count's name is replaced.
    """
    found, new = common.fresh(docs.columns, "found"), common.fresh(docs.columns, "new")
    col = F.col(f"`{text_col}`")
    out = docs.withColumn(found, F.regexp_extract_all(col, F.lit(ANY), F.lit(0))).withColumn(new, F.expr(f"transform({found}, m -> {pseudonym('m', key)})"))
    pieces = F.split(col, ANY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, new, lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    if count:
        out = out.withColumn(count, F.coalesce(F.when(col.isNotNull(), changed), F.lit(0)))
    return out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(col)).drop(found, new)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
