r"""Format-preserving pseudonyms for personal data (operator 7), in Spark SQL expressions only.

One pattern finds what may be personal data; what a match is, its validation
decides: payment cards (13 to 19 digits with a right Luhn digit, also in fours),
phone numbers (ten digits in brackets-and-dash, dashed or dotted form), social
security numbers with ranges in use, IPv4 addresses and calendar dates. Each is
keyed-permuted within its format by a Feistel network of ten rounds whose round
function is SHA-256 under the key: digits on halves of the digits (a card's
payload, whose Luhn digit is then set anew), social security numbers on the area
and the rest, both counted among those in use, addresses on 16-bit halves, dates on
the bytes of the day within its block of 65,536 days. A date with the month first,
known as such by a day beyond 12, is permuted again until its day is beyond 12 (in
at most WALKS steps; more are needed with a chance of 3 in 10**26). So a pseudonym
passes the same validation, equal values have equal pseudonyms in all documents, and
different values different ones. E-mail addresses
and quoted hexadecimal secrets (32, 40 or 64 digits) are no numbers: their local
part, or the digits, become keyed hashes, which keep links too.

The key has no default. It comes to the tasks as a scalar subquery, so no plan shows
it; a caller may also give a column of their own, such as a subquery on a protected
file. The registered query takes it from the setting SECRET, whose name Spark's own
redaction covers, or else uses a demonstration key; the pipeline never does.

The work is one projection: no shuffle, no Python; texts without a digit or an @
pass by one test. Matches lie in order, so they are put back between the parts
of the split text and no pseudonym is taken for another match.

Defined cases: null text stays null with n_pseudonyms 0, empty text stays empty;
null doc_ids are passed through; repeated rows are replaced alike; an empty table
gives no rows; other columns are not read by pii(), and kept by pseudonymize(), whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The setting that names a deployment's key, and the key of the registered query without it.
SECRET, DEMONSTRATION = "spark.lattica.pii.secret", "lattica-demo-key"
ROUNDS, WALKS = 10, 64
#: Social security numbers in use: areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999.
AREAS, GROUPS, SERIALS, NO_AREA = 898, 99, 9999, 666

PATTERN = (
    r"[\p{L}0-9._%+-]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+"  # e-mail
    r"|[\"'=][0-9A-Fa-f]{32,}"  # secret
    r"|\([0-9]+\) ?[0-9]+-[0-9]+"  # phone
    r"|[0-9]{4}(?: [0-9]{4})+"  # card in fours
    r"|[0-9]+(?:\.[0-9]+)+|[0-9]+(?:-[0-9]+)+|[0-9]+(?:/[0-9]+)+|[0-9]+"
)

#: What a match v is: name and condition, the first that holds. {d}: its digits.
_D = "regexp_replace(v, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length({x})), 0, (s, i) -> s + (CASE WHEN (length({x}) - i) % 2 = {odd}
  THEN 2 * cast(substring({x}, i, 1) AS int) - (CASE WHEN substring({x}, i, 1) > '4' THEN 9 ELSE 0 END) ELSE cast(substring({x}, i, 1) AS int) END))"""


def _kind() -> str:
    in_range = lambda i: f"cast(split(v, '[.]')[{i}] AS int) <= 255"
    return f"""CASE
      WHEN contains(v, '@') THEN 'email'
      WHEN v rlike '^.(?:[0-9A-Fa-f]{{32}}|[0-9A-Fa-f]{{40}}|[0-9A-Fa-f]{{64}})$' AND v rlike '[A-Fa-f]' AND v rlike '[0-9]' AND NOT v rlike '^[0-9]' THEN 'secret'
      WHEN v rlike '^\\\\([0-9]{{3}}\\\\) ?[0-9]{{3}}-[0-9]{{4}}$' OR v rlike '^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' THEN 'phone'
      WHEN v rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' AND NOT v rlike '^(?:000|666|9)' AND NOT v rlike '-00-' AND NOT v rlike '-0000$' THEN 'ssn'
      WHEN v rlike '^[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}$' THEN CASE WHEN {" AND ".join(map(in_range, range(4)))} THEN 'ip' END
      WHEN v rlike '^[0-9]{{4}}([-/.])[0-9]{{2}}[-/.][0-9]{{2}}$' OR v rlike '^[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}}$' THEN CASE WHEN {_day()} BETWEEN 0 AND {65536 * 55 - 1} THEN 'date' END
      WHEN (v rlike '^[0-9]{{13,19}}$' OR v rlike '^[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}$') AND {_LUHN.format(x=_D, odd=1)} % 10 = 0 THEN 'card'
    END"""


def _order() -> str:
    """How a date is written: y (year first), d (day first) or m (month first)."""
    return "CASE WHEN v rlike '^[0-9]{4}' THEN 'y' WHEN try_cast(concat(substring(v, 7, 4), '-', substring(v, 4, 2), '-', substring(v, 1, 2)) AS date) IS NOT NULL THEN 'd' ELSE 'm' END"


def _day() -> str:
    """Days of a date match since the year 1, or null."""
    iso = f"""(CASE {_order()}
      WHEN 'y' THEN concat(substring(v, 1, 4), '-', substring(v, 6, 2), '-', substring(v, 9, 2))
      WHEN 'd' THEN concat(substring(v, 7, 4), '-', substring(v, 4, 2), '-', substring(v, 1, 2))
      ELSE concat(substring(v, 7, 4), '-', substring(v, 1, 2), '-', substring(v, 4, 2)) END)"""
    return f"datediff(try_cast({iso} AS date), DATE'0001-01-01')"


def replaced(text: str, key: str) -> str:
    """SQL for a struct of the new text and the number of pseudonyms. text, key: column names, quoted."""
    pattern = PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    found = f"transform(regexp_extract_all({text}, '{pattern}', 0), v -> named_struct('v', v, 'kind', {_kind()}))"
    # The digits that are permuted; for a card all but its last.
    all_digits = _D.replace("v,", "x.v,")
    digits = f"""transform({found}, x -> named_struct('v', x.v, 'kind', x.kind,
      'd', CASE WHEN x.kind IN ('phone', 'ssn') THEN {all_digits} WHEN x.kind = 'card' THEN left({all_digits}, length({all_digits}) - 1) ELSE '' END,
      'day', CASE WHEN x.kind = 'date' THEN {_in_struct(_day())} END, 'order', CASE WHEN x.kind = 'date' THEN {_in_struct(_order())} END))"""
    octet = lambda i: f"cast(split(x.v, '[.]')[{i}] AS bigint)"
    area = "cast(left(x.d, 3) AS bigint)"
    half = "length(x.d) div 2"
    halves = f"""transform({digits}, x -> named_struct('v', x.v, 'kind', x.kind, 'd', x.d, 'day', x.day, 'order', x.order,
      'a', CASE x.kind WHEN 'phone' THEN cast(left(x.d, cast({half} AS int)) AS bigint) WHEN 'card' THEN cast(left(x.d, cast({half} AS int)) AS bigint) WHEN 'ip' THEN {octet(0)} * 256 + {octet(1)} WHEN 'date' THEN (x.day % 65536) div 256
        WHEN 'ssn' THEN {area} - 1 - CASE WHEN {area} > {NO_AREA} THEN 1 ELSE 0 END END,
      'b', CASE x.kind WHEN 'phone' THEN cast(substring(x.d, cast({half} AS int) + 1) AS bigint) WHEN 'card' THEN cast(substring(x.d, cast({half} AS int) + 1) AS bigint) WHEN 'ip' THEN {octet(2)} * 256 + {octet(3)} WHEN 'date' THEN cast(x.day % 256 AS bigint)
        WHEN 'ssn' THEN (cast(substring(x.d, 4, 2) AS bigint) - 1) * {SERIALS} + cast(substring(x.d, 6) AS bigint) - 1 END,
      'm', CASE WHEN x.kind IN ('phone', 'card') THEN cast(concat('1', repeat('0', cast({half} AS int))) AS bigint) WHEN x.kind = 'ip' THEN 65536L WHEN x.kind = 'date' THEN 256L WHEN x.kind = 'ssn' THEN {AREAS}L END,
      'n', CASE WHEN x.kind IN ('phone', 'card') THEN cast(concat('1', repeat('0', length(x.d) - cast({half} AS int))) AS bigint) WHEN x.kind = 'ip' THEN 65536L WHEN x.kind = 'date' THEN 256L WHEN x.kind = 'ssn' THEN {GROUPS * SERIALS}L END))"""
    code = f"cast(conv(left(sha2(concat_ws('|', {key}, x.kind, length(x.d), i, s.b), 256), 12), 16, 10) AS bigint)"
    rounds = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', t.a, 'b', t.b), (s, i) -> named_struct('a', s.b, 'b', (s.a + {code}) % (CASE WHEN i % 2 = 0 THEN x.m ELSE x.n END)))"
    to_day = "date_add(DATE'0001-01-01', cast((x.day div 65536) * 65536 + {r}.a * 256 + {r}.b AS int))"
    # Permuted once, or again until a date with the month first has a day beyond 12.
    walked = f"""transform({halves}, x -> named_struct('v', x.v, 'kind', x.kind, 'd', x.d, 'day', x.day, 'order', x.order, 'r', CASE WHEN x.a IS NOT NULL THEN
      aggregate(sequence(1, CASE WHEN x.order = 'm' THEN {WALKS} ELSE 1 END), named_struct('a', x.a, 'b', x.b), (t, j) -> CASE WHEN j > 1 AND dayofmonth({to_day.format(r="t")}) > 12 THEN t ELSE {rounds} END) END))"""
    joined = f"concat(lpad(cast(x.r.a AS string), cast({half} AS int), '0'), lpad(cast(x.r.b AS string), length(x.d) - cast({half} AS int), '0'))"
    printed = f"""transform({walked}, x -> named_struct('v', x.v, 'kind', x.kind, 'order', x.order, 'p', CASE
      WHEN x.kind IN ('phone', 'card') THEN {joined}
      WHEN x.kind = 'ssn' THEN concat(lpad(cast(x.r.a + 1 + CASE WHEN x.r.a + 1 >= {NO_AREA} THEN 1 ELSE 0 END AS string), 3, '0'), lpad(cast(x.r.b div {SERIALS} + 1 AS string), 2, '0'), lpad(cast(x.r.b % {SERIALS} + 1 AS string), 4, '0'))
      WHEN x.kind = 'ip' THEN concat_ws('.', x.r.a div 256, x.r.a % 256, x.r.b div 256, x.r.b % 256)
      WHEN x.kind = 'date' THEN lpad(cast({to_day.format(r="x.r")} AS string), 10, '0')
      WHEN x.kind = 'email' THEN concat('u', left(sha2(concat_ws('|', {key}, 'email', lower(x.v)), 256), 16), substring(x.v, instr(x.v, '@')))
      WHEN x.kind = 'secret' THEN concat(left(x.v, 1), left(sha2(concat_ws('|', {key}, 'secret', lower(substring(x.v, 2))), 256), length(x.v) - 1)) END))"""
    card = f"concat(x.p, cast((10 - {_LUHN.format(x='x.p', odd=0)} % 10) % 10 AS string))"
    fours = "concat_ws(substring(x.v, 5, 1), substring(x.p, 1, 4), substring(x.p, 5, 4), substring(x.p, 9, 4), substring(x.p, 13, 4))"
    final = f"transform({printed}, x -> named_struct('v', x.v, 'kind', x.kind, 'order', x.order, 'p', CASE WHEN x.kind = 'card' THEN {card} ELSE x.p END))"
    shaped = f"""transform({final}, x -> named_struct('is', x.kind IS NOT NULL, 'o', CASE
      WHEN x.kind = 'card' AND NOT x.v rlike '^[0-9]+$' THEN {fours}
      WHEN x.kind = 'phone' AND x.v rlike '^[(]' THEN concat('(', left(x.p, 3), ')', CASE WHEN contains(x.v, ' ') THEN ' ' ELSE '' END, substring(x.p, 4, 3), '-', substring(x.p, 7))
      WHEN x.kind = 'phone' THEN concat(left(x.p, 3), substring(x.v, 4, 1), substring(x.p, 4, 3), substring(x.v, 8, 1), substring(x.p, 7))
      WHEN x.kind = 'ssn' THEN concat(left(x.p, 3), '-', substring(x.p, 4, 2), '-', substring(x.p, 6))
      WHEN x.kind = 'date' THEN CASE x.order
        WHEN 'y' THEN concat(left(x.p, 4), substring(x.v, 5, 1), substring(x.p, 6, 2), substring(x.v, 8, 1), substring(x.p, 9, 2))
        WHEN 'd' THEN concat(substring(x.p, 9, 2), substring(x.v, 3, 1), substring(x.p, 6, 2), substring(x.v, 6, 1), left(x.p, 4))
        ELSE concat(substring(x.p, 6, 2), substring(x.v, 3, 1), substring(x.p, 9, 2), substring(x.v, 6, 1), left(x.p, 4)) END
      ELSE coalesce(x.p, x.v) END))"""
    between = f"split({text}, '{pattern}', -1)"
    return f"transform(array({shaped}), f -> named_struct('text', array_join(zip_with({between}, f, (p, o) -> concat(p, coalesce(o.o, ''))), ''), 'n', cast(size(filter(f, o -> o.is)) AS bigint)))[0]"


def _in_struct(sql: str) -> str:
    import re

    return re.sub(r"\bv\b", "x.v", sql)


def _pseudonyms(docs: DataFrame, key: str | Column) -> tuple[DataFrame, str]:
    """docs with a struct of the new text and the count, null where nothing can be personal data, and that column's name."""
    if isinstance(key, str):
        key = docs.sparkSession.createDataFrame([(key,)], "key string").select("key").scalar()
    names = []
    for name in ("__pii_text", "__pii_key", "__pii"):
        names.append(fresh([*docs.columns, *names], name))
    text, secret, out = names
    named = docs.withColumn(text, F.col("text").cast("string")).withColumn(secret, key)
    return named.withColumn(out, F.when(F.col(text).rlike("[0-9@]") | F.col(text).rlike("[\"'=][A-Fa-f0-9]{32}"), F.expr(replaced(text, secret)))), out


def pii(docs: DataFrame, key: str | Column) -> DataFrame:
    """doc_id, text with pseudonyms, and their number, per row of docs."""
    found, out = _pseudonyms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    return found.select("doc_id", F.coalesce(F.col(out)["text"], "text").alias("text"), F.coalesce(F.col(out)["n"], F.lit(0).cast("long")).alias("n_pseudonyms"))


def pseudonymize(docs: DataFrame, key: str | Column) -> DataFrame:
    """docs with pseudonyms in text, all columns kept in order."""
    found, out = _pseudonyms(docs, key)
    return found.select(*(F.coalesce(F.col(out)["text"], F.col("text").cast("string")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def configured(spark: SparkSession) -> str:
    """The key named by the setting SECRET. Without it a session gets a random key of its own, kept in that setting:
    equal values stay linked within the session, and nobody can undo the pseudonyms later."""
    if not spark.conf.get(SECRET, None):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return spark.conf.get(SECRET)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pii(read(spark, sf_dir, "documents"), spark.conf.get(SECRET, DEMONSTRATION))


def brute_force(text: str | None, key: str = DEMONSTRATION) -> tuple[str | None, int]:
    """The same for one text in plain Python, for tests."""
    import datetime
    import hashlib
    import re

    import regex

    def sha(*parts) -> str:
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()

    def walk(kind: str, n: int, a: int, b: int, m: int, k: int) -> tuple[int, int]:
        for i in range(ROUNDS):
            a, b = b, (a + int(sha(key, kind, n, i, b)[:12], 16)) % (k if i % 2 else m)
        return a, b

    def luhn(d: str, odd: int) -> int:
        return sum((2 * int(c) - 9 * (int(c) > 4)) if (len(d) - i) % 2 == odd else int(c) for i, c in enumerate(d, 1))

    def digits(kind: str, d: str) -> str:
        h = len(d) // 2
        a, b = walk(kind, len(d), int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
        return f"{a:0{h}d}{b:0{len(d) - h}d}"

    def date(y: str, m: str, d: str) -> datetime.date | None:
        try:
            return datetime.date(int(y), int(m), int(d))
        except ValueError:
            return None

    count = 0

    def new(match) -> str:
        nonlocal count
        v = match[0]
        d = re.sub("[^0-9]", "", v)
        out = None
        if "@" in v:
            out = "u" + sha(key, "email", v.lower())[:16] + v[v.index("@") :]
        elif re.fullmatch(r"[^0-9](?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})", v) and re.search("[A-Fa-f]", v) and d:
            out = v[0] + sha(key, "secret", v[1:].lower())[: len(v) - 1]
        elif re.fullmatch(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", v):
            it = iter(digits("phone", d))
            out = re.sub("[0-9]", lambda _: next(it), v)
        elif re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", v) and not re.match("000|666|9", v) and "-00-" not in v and not v.endswith("-0000"):
            area, rest = int(d[:3]), (int(d[3:5]) - 1) * SERIALS + int(d[5:]) - 1
            a, b = walk("ssn", 9, area - 1 - (area > NO_AREA), rest, AREAS, GROUPS * SERIALS)
            out = f"{a + 1 + (a + 1 >= NO_AREA):03d}-{b // SERIALS + 1:02d}-{b % SERIALS + 1:04d}"
        elif re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", v):
            o = list(map(int, v.split(".")))
            if max(o) < 256:
                a, b = walk("ip", 0, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
                out = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        elif re.fullmatch(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}", v):
            p = re.split("[-/.]", v)
            order = "ymd" if len(p[0]) == 4 else "dmy" if date(p[2], p[1], p[0]) else "mdy"
            at = date(*(p[order.index(c)] for c in "ymd"))
            if at and (day := at.toordinal() - 1) < 65536 * 55:
                a, b = day % 65536 // 256, day % 256
                for _ in range(WALKS if order == "mdy" else 1):
                    a, b = walk("date", 0, a, b, 256, 256)
                    to = datetime.date.fromordinal(day // 65536 * 65536 + a * 256 + b + 1)
                    if to.day > 12:
                        break
                parts = {"y": f"{to.year:04d}", "m": f"{to.month:02d}", "d": f"{to.day:02d}"}
                seps = re.findall("[-/.]", v)
                out = parts[order[0]] + seps[0] + parts[order[1]] + seps[1] + parts[order[2]]
        elif re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}", v) and luhn(d, 1) % 10 == 0:
            p = digits("card", d[:-1])
            it = iter(p + str((10 - luhn(p, 0) % 10) % 10))
            out = re.sub("[0-9]", lambda _: next(it), v)
        count += out is not None
        return v if out is None else out

    if text is None:
        return None, 0
    text = regex.sub(PATTERN, new, text)
    return text, count
