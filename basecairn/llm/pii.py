"""PII: format-preserving Feistel pseudonyms, with DataFrame operations only.

Candidates are found by one pattern, validated (Luhn digit, octets, calendar) and replaced within their format by a
keyed permutation, so equal values stay linked across documents and different values stay different:

* card and account numbers (13-19 digits in whole groups, with a valid Luhn digit): all digits but the last are permuted, the last
  is computed. In a run of digit groups numbers of one group go first, then the usual groupings of cards, then others from the left,
  longer ones first; what is left of the run is searched for the other kinds;
* phone numbers: all digits after the country code; US social security numbers: all nine digits;
* IPv4 addresses: the 32 bits; dates (1800-2199, yyyy-mm-dd or d/m/yyyy): the day, within the 146,097 days of 400 years;
* e-mail addresses: letters and digits of the local part; access keys and hex tokens: all characters after a fixed prefix.

A Feistel round adds to one half, character by character modulo the alphabet, a SHA-512 of key, kind, round and the other
half; any round is undone by subtracting, so with ``inverse`` the same key turns pseudonyms back. The key is the caller's secret:
whoever has it can invert. Nothing is shuffled, nothing leaves the row.
Limit: a pseudonym in a run of digit groups may by chance give a valid number with its neighbours that goes before the right one;
such a run is not inverted.

Defined results: null text stays null, empty stays empty, what fails validation stays as it is. Repeated rows: each alike. No
documents: no rows. Whole texts are searched, however long. A column pii that docs has already is replaced, other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, HEX, LOWER, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DAYS, SPAN = (189, 773), 146097  # 189 * 773 days

#: What follows a digit group that begins an address or a date.
TAIL = r"(?:\.\d{1,3}){3}\b|/\d{1,2}/\d{4}\b|[A-Za-z0-9._%+-]{0,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
#: kind -> pattern, the first that matches at a place counts. That of cards is a whole run of digit groups, which may hold several values.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "phone": r"\+\d{1,3} ?\(\d{3}\) ?\d{3}[- ]\d{4}\b|\+\d{1,3}[ -]\d{3}[ -]\d{3}[ -]\d{4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b",
    "card": r"\b(?=\d(?:[ -]?\d){12})\d++\b(?:[ -]\d++\b)*+" + f"(?:{TAIL})?",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"\b[0-9a-f]{32,64}\b",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
OTHERS = "|".join(f"(?:{p})" for kind, p in KINDS.items() if kind != "card")
#: Digits in the groups of usual card numbers.
LAYOUTS = ("4,4,4,4", "4,6,5", "4,6,4", "4,4,4,4,3")
#: Whatever any pattern of KINDS matches has one of these.
HINT = "[0-9]|@|AKIA|[a-f]{32}"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rounds(inverse: bool) -> str:
    return f"sequence({ROUNDS - 1}, 0)" if inverse else f"sequence(0, {ROUNDS - 1})"


def permuted(value: str, alphabet: str, kind: str, key: str, inverse: bool = False) -> str:
    """SQL for the keyed permutation of a string over an alphabet (2 to 128 characters long; one character: a keyed shift)."""
    base, sign = len(alphabet), "-" if inverse else "+"
    digest = lambda other: f"sha2(concat({_lit(key + ':' + kind + ':')}, length({value}), ':', i, ':', {other}), 512)"

    def shifted(half: str, other: str) -> str:
        h = digest(other)
        one = f"substr({_lit(alphabet)}, int(pmod(instr({_lit(alphabet)}, c.c) - 1 {sign} int(conv(substr(d.d, 2 * c.j + 1, 2), 16, 10)), {base})) + 1, 1)"
        # the digest is bound once, as the element of an array of one
        return f"array_join(flatten(transform(array(named_struct('d', {h})), d -> transform(transform(split({half}, ''), (x, j) -> named_struct('c', x, 'j', j)), c -> {one}))), '')"

    left = f"if(a.l = '', '', {shifted('a.l', 'a.r')})"
    right = shifted("a.r", "a.l")
    start = f"named_struct('l', substr({value}, 1, length({value}) div 2), 'r', substr({value}, length({value}) div 2 + 1))"
    step = f"(a, i) -> if(i % 2 = 0, named_struct('l', {left}, 'r', a.r), named_struct('l', a.l, 'r', {right}))"
    return f"if({value} = '', '', aggregate({_rounds(inverse)}, {start}, {step}, a -> concat(a.l, a.r)))"


def permuted_day(day: str, key: str, inverse: bool = False) -> str:
    """SQL for the keyed permutation of a day number from 0 to 146,096: a Feistel network over 189 x 773 by modular addition."""
    (m, n), sign = DAYS, "-" if inverse else "+"
    f = lambda x: f"bigint(conv(substr(sha2(concat({_lit(key + ':date:')}, i, ':', {x}), 256), 1, 12), 16, 10))"
    step = f"(a, i) -> if(i % 2 = 0, named_struct('l', pmod(a.l {sign} {f('a.r')}, {m}L), 'r', a.r), named_struct('l', a.l, 'r', pmod(a.r {sign} {f('a.l')}, {n}L)))"
    return f"aggregate({_rounds(inverse)}, named_struct('l', bigint({day}) div {n}, 'r', bigint({day}) % {n}), {step}, a -> a.l * {n} + a.r)"


def _luhn(digits: str, skip: int) -> str:
    """SQL: sum of Luhn's digits, doubling every second from the right; skip = 1: as if a last digit followed."""
    d = "int(substr(reverse(_s), p, 1))".replace("_s", digits)
    return f"aggregate(transform(sequence(1, length({digits})), p -> if(p % 2 = {1 if skip else 0}, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d})), 0, (t, x) -> t + x)"


def _bind(name: str, value: str, body: str) -> str:
    """SQL for body with name standing for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _refilled(original: str, chars: str, keep: str) -> str:
    """SQL: original with its characters of class keep replaced, in order, by those of chars."""
    return f"array_join(transform(split({original}, ''), (c, p) -> if(c rlike '{keep}', substr({chars}, length(regexp_replace(substr({original}, 1, p + 1), '[^{keep[1:-1]}]', '')), 1), c)), '')"


def replaced(m: str, key: str, inverse: bool = False) -> str:
    """SQL for a match m: its pseudonym (inverse: its original) if it is valid, else m itself."""
    p = lambda v, alphabet, kind: permuted(v, alphabet, kind, key, inverse)
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = _bind("lo", f"substring_index({m}, '@', 1)", f"concat({_bind('al', "regexp_replace(lo, '[^A-Za-z0-9]', '')", _refilled('lo', '(' + f"if(al rlike '[A-Z]', {p('al', ALNUM, 'email')}, {p('al', LOWER, 'email')})" + ')', '[A-Za-z0-9]'))}, substr({m}, length(lo) + 1))")
    national = f"regexp_replace(regexp_replace({m}, '^\\\\+\\\\d+', ''), '[^0-9]', '')"
    phone = _bind("na", national, _bind("pn", p("na", DIGITS, "phone"), f"concat(regexp_extract({m}, '^(\\\\+\\\\d+)?', 0), {_bind('rs', f"regexp_replace({m}, '^\\\\+\\\\d+', '')", _refilled('rs', 'pn', '[0-9]'))})"))
    ssn = _bind("pn", p(digits, DIGITS, "ssn"), _refilled(m, "pn", "[0-9]"))
    octets = f"split({m}, '[.]')"
    quad = f"array_join(transform({octets}, o -> lpad(lower(hex(int(o))), 2, '0')), '')"
    dotted = _bind("ph", _bind("qh", quad, p("qh", HEX, "ip")), "array_join(transform(sequence(0, 3), o -> conv(substr(ph, 2 * o + 1, 2), 16, 10)), '.')")
    ip = f"if(forall({octets}, o -> int(o) <= 255), {dotted}, {m})"
    day = f"coalesce(try_to_date({m}, 'yyyy-MM-dd'), try_to_date({m}, 'd/M/yyyy'))"
    moved = _bind("nd", f"date_add(date'1800-01-01', int({permuted_day(f"datediff(da, date'1800-01-01')", key, inverse)}))", f"if({m} like '%-%', date_format(nd, 'yyyy-MM-dd'), concat(lpad(day(nd), length(substring_index({m}, '/', 1)), '0'), '/', lpad(month(nd), length(split({m}, '/')[1]), '0'), '/', year(nd)))")
    # d/m/yyyy is written without padding where the number needs more places
    moved = moved.replace("lpad(day(nd), length(", "lpad(day(nd), greatest(length(string(day(nd))), length(").replace(", '/', 1)), '0')", ", '/', 1))), '0')").replace("lpad(month(nd), length(", "lpad(month(nd), greatest(length(string(month(nd))), length(").replace(", '/')[1]), '0')", ", '/')[1])), '0')")
    date = _bind("da", day, f"if(da between date'1800-01-01' and date'2199-12-31', {moved}, {m})")
    body = _bind("pb", p("substr(di, 1, length(di) - 1)", DIGITS, "card"), f"concat(pb, (10 - {_luhn('pb', 1)} % 10) % 10)")
    card = _bind("di", digits, f"if({_luhn('di', 0)} % 10 = 0, {_bind('pn', body, _refilled(m, 'pn', '[0-9]'))}, {m})")
    access = f"concat('AKIA', {p(f'substr({m}, 5)', UPPER, 'key')})"
    return f"""case kind_of when 'email' then {email} when 'phone' then {phone} when 'ip' then {ip} when 'ssn' then {ssn} when 'date' then {date}
        when 'card' then {card} when 'key' then {access} when 'token' then {p(m, HEX, 'token')} else {m} end"""


def _kind(m: str, but: str = "") -> str:
    return "case " + " ".join(f"when {m} rlike {_lit('^(?:' + pattern + ')$')} then '{kind}'" for kind, pattern in KINDS.items() if kind != but) + " end"


def _numbers(groups: str) -> str:
    """SQL: the card numbers among digit groups, in order: i (from 0), n groups, d (digits)."""
    span = f"transform(sequence(1, least(19, size({groups}) - i)), n -> named_struct('i', i, 'n', n, 'd', array_join(slice({groups}, i + 1, n), '')))"
    valid = f"flatten(transform({groups}, (g, i) -> filter({span}, s -> length(s.d) between 13 and 19 and {_luhn('s.d', 0)} % 10 = 0)))"
    layout = f"array_join(transform(slice({groups}, v.i + 1, v.n), g -> string(length(g))), ',')"
    rank = f"case when v.n = 1 then 0 when {layout} in ({', '.join(map(_lit, LAYOUTS))}) then 1 else 2 end"
    ranked = f"array_sort(transform({valid}, v -> named_struct('rank', {rank}, 'i', v.i, 'less', -v.n, 'n', v.n, 'd', v.d)))"
    step = "(a, c) -> if(exists(a, y -> c.i < y.i + y.n and y.i < c.i + c.n), a, array_append(a, named_struct('i', c.i, 'n', c.n, 'd', c.d)))"
    return f"array_sort(aggregate({ranked}, cast(array() as array<struct<i: int, n: int, d: string>>), {step}))"


def _parts(m: str) -> str:
    """SQL: the kinds and values that a match m consists of; kind null for what stays."""
    plain = lambda v: f"named_struct('kind', cast(null as string), 'was', {v})"
    at = "length(array_join(slice(gs, 1, c.i), '')) + c.i + 1"
    step = f"(a, c) -> {_bind('o', at, f"named_struct('p', o + length(c.d) + c.n - 1, 's', concat(a.s, array({plain(f'substr({m}, a.p, o - a.p)')}, named_struct('kind', 'card', 'was', substr({m}, o, length(c.d) + c.n - 1)))))")}"
    cut = f"aggregate({_numbers('gs')}, named_struct('p', 1, 's', cast(array() as array<struct<kind: string, was: string>>)), {step}, a -> array_append(a.s, {plain(f'substr({m}, a.p)')}))"
    groups = f"regexp_extract_all(regexp_extract({m}, {_lit(r'^\d++(?:[ -]\d++\b)*+')}, 0), {_lit(r'\d+')}, 0)"
    between = f"flatten(transform(split(r.was, {_lit(OTHERS)}, -1), (x, n) -> if(n < size(os), array({plain('x')}, named_struct('kind', {_kind('os[n]', 'card')}, 'was', os[n])), array({plain('x')}))))"
    rest = _bind("os", f"regexp_extract_all(r.was, {_lit(OTHERS)}, 0)", between)
    run = f"flatten(transform({_bind('gs', groups, cut)}, r -> if(r.kind = 'card', array(r), {rest})))"
    return f"transform(array({_kind(m)}), k -> if(k = 'card', {run}, array(named_struct('kind', k, 'was', {m}))))[0]"


def _pairs(text: str, key: str, inverse: bool) -> str:
    """SQL: for each match in text what it consists of, each part with its kind, itself and what stands for it."""
    one = replaced("w", key, inverse).replace("kind_of", "q.kind")
    return f"transform(regexp_extract_all({text}, {_lit(PATTERN)}, 0), m -> transform({_parts('m')}, q -> transform(array(q.was), w -> named_struct('kind', q.kind, 'was', w, 'now', {one}))[0]))"


def pseudonymised(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """docs with text rewritten and pii: an array of (kind, was, now), one for each replaced value in order.

    With inverse, pseudonyms made under the key turn back into the originals.
    """
    some = f"text rlike {_lit(HINT)}"
    found = docs.withColumn("text", F.col("text").cast("string")).withColumn("__all", F.expr(f"case when {some} then {_pairs('text', key, inverse)} else array() end"))
    text = f"""case when size(__all) > 0 then concat_ws('', transform(split(text, {_lit(PATTERN)}, -1), (x, n) -> concat(x, if(n < size(__all), array_join(transform(__all[n], y -> y.now), ''), '')))) else text end"""
    return found.withColumns({"text": F.expr(text), "pii": F.expr("filter(flatten(__all), x -> x.now <> x.was)")}).drop("__all")
