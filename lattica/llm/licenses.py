"""License scans by sentence rules (operator 3).

A text is split into sentences, after full stops and the like and at lines without
letters or digits; sentences are normalised (lower case, letters, digits and dots
between them only). A sentence that goes over several lines counts as a whole if
it is known, else each of its lines as a sentence. Tables map normalised sentences
to identifiers: short sentences, those of the standard texts, split and normalised in
the same way, and over a thousand notices, built from the names of licences. RULES are
sequences of identifiers in order: a rule matches where its identifiers follow one
another among the text's known sentences, other sentences in between being skipped.
Names of holders in a known sentence count as one, a pointer to a licence file at a sentence's
end does not count, "licensed under the A or the B" is a notice for each, and an SPDX line holds an
expression: an identifier for each licence that it names.
Rules are tried from the longest to the shortest and take their sentences out, so the
text of BSD-3-Clause is not BSD-2-Clause too, while both texts in a document are found.

The tables are of a fixed size, so the scan is one projection with literals, a hash
lookup for each sentence: no shuffle, no Python, no broadcast.

Defined cases: null or empty text has no sentences and no licences; null doc_ids
are passed through; repeated rows are scanned each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_tables import RULES, SENTENCES, STANDARD, notices

#: Between lines with letters or digits, lines without; and what goes from a sentence: marks, but for dots inside numbers.
_BLANK, _MARKS = r"\n(?:[^\p{L}\p{N}\n]*\n)+", r"[^a-z0-9.]+|\.(?:[^0-9]|$)"


#: What is rewritten in a normalised sentence: names of holders, and pointers to a licence file.
_REWRITTEN = (
    ("^neither the names? of .* nor the names of (?:its|their|any|the) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (" see (?:the )?(?:(?:license|licence|copying) ?)+(?:d|xt|md|txt)?(?: ?file)?(?: ?for (?:more |full )?(?:details|information|(?:the )?full text))?$", ""),
)
#: The start of an SPDX line, an exception in its expression, what joins licences, and the start of a notice for several.
_SPDX, _EXCEPTION, _JOINED, _UNDER = "spdx license identifier ", " with [a-z0-9. ]*?exception(?: [0-9.]+)?", " (?:or|and) (?:the )?", "^.*licen[sc]ed under (?:either of |either |one of )?(?:the )?"
_SPDX_LINE = "(?i)spdx-license-identifier:"
#: Abbreviations in names of holders, whose full stop ends no sentence.
_SHORT = r"(?i)\b(inc|ltd|corp|co)\."


def normalised(sentence: str) -> str:
    return re.sub(" +", " ", re.sub(_MARKS, " ", sentence.lower())).strip(" ")


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return notices() | SENTENCES | {normalised(s): name for s, name in STANDARD}


def _rule(ids: tuple[str, ...]) -> tuple[str, int]:
    """A pattern for identifiers, each between bars, that holds ids in order and takes apart what lies between, and the number of gaps."""
    return r"\|" + r"\|((?:[^|]+\|)*?)".join(ids) + r"\|", len(ids) - 1


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sequence (their identifiers in order) and licenses (sorted, separated by commas) per row of docs.

    sentences: normalised sentences of any length and their identifiers; by default the module's. rules: licences and their identifiers, tried in this order.
    """
    sentences = {k: v for k, v in (sentence_table() if sentences is None else sentences).items() if k}
    # Sentences end with a NUL, their lines with a line end.
    text = F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\0\r", "  "), _SPDX_LINE, "SPDX-License-Identifier ")
    text = F.regexp_replace(text, _SHORT, "$1 ")
    wholes = F.split(F.regexp_replace(F.regexp_replace(text, _BLANK, "\0"), r"([.!?;:])(?:[ \t]+|[ \t]*\n)", "$1\0"), "\0")
    def bare(s: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({s}), {_quoted(_MARKS)}, ' '), ' +', ' '))"
        for pattern, by in _REWRITTEN:
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)})"
        return out

    known = f"map({', '.join(_quoted(x) for kv in sentences.items() for x in kv)})" if sentences else "cast(map() AS map<string,string>)"
    is_known = lambda p: f"{p} IN ({', '.join(map(_quoted, sentences))})" if sentences else "false"
    none = "cast(array() AS array<string>)"
    # What is looked up for a sentence b: itself, the licences of an SPDX line, or a notice for each licence of several.
    spdx = f"startswith(b, {_quoted(_SPDX)})"
    named = f"split(regexp_replace(substring(b, {len(_SPDX) + 1}), {_quoted(_EXCEPTION)}, ''), {_quoted(_JOINED)})"
    several = f"transform(split(regexp_replace(b, {_quoted(_UNDER)}, ''), {_quoted(_JOINED)}), p -> concat('licensed under the ', p))"
    asked = f"CASE WHEN {spdx} THEN {named} WHEN NOT {is_known('b')} AND b RLIKE {_quoted(_UNDER)} AND b RLIKE {_quoted(_JOINED)} THEN {several} ELSE array(b) END"
    looked_up = f"filter(transform(q, p -> CASE WHEN {is_known('p')} THEN {known}[p] END), i -> i IS NOT NULL)"
    # Identifiers of an SPDX line are told from others; of several licences all must be known.
    kept = f"CASE WHEN {spdx} THEN transform(filter(f, i -> endswith(i, '-id')), i -> concat('spdx:', i)) WHEN size(f) = size(q) THEN f ELSE {none} END"
    ids_of = lambda s: f"transform(array({bare(s)}), b -> transform(array({asked}), q -> transform(array({looked_up}), f -> {kept})[0])[0])[0]"
    lines = f"flatten(transform(split(s, '\n'), l -> {ids_of('l')}))"
    whole = f"transform(array({ids_of('s')}), w -> CASE WHEN size(w) = 0 AND contains(s, '\n') THEN {lines} ELSE w END)[0]"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), wholes.alias("wholes")).select("doc_id", F.expr(f"flatten(transform(wholes, s -> {whole}))").alias("found"))
    names = "cast(array() AS array<string>)"
    if rules:
        structs = []
        for name, ids in rules:
            pattern, gaps = _rule(ids)
            structs.append(f"named_struct('name', {_quoted(name)}, 'pattern', {_quoted(pattern)}, 'rest', {_quoted('|' + ''.join(f'${i + 1}' for i in range(gaps)))})")
        start = f"named_struct('seq', concat('|', array_join(found, '|'), '|'), 'names', {names})"
        step = "CASE WHEN acc.seq RLIKE r.pattern THEN named_struct('seq', regexp_replace(acc.seq, r.pattern, r.rest), 'names', array_append(acc.names, r.name)) ELSE acc END"
        names = f"CASE WHEN size(found) = 0 THEN {names} ELSE aggregate(array({', '.join(structs)}), {start}, (acc, r) -> {step}, acc -> array_sort(array_distinct(acc.names))) END"
    return out.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join("found", " ").alias("sequence"), F.array_join(F.expr(names), ",").alias("licenses"))


def _oracle() -> str:
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in sentence_table().items())
    ruled = [(name, *_rule(ids)) for name, ids in RULES]
    rules = ", ".join(f"({i}, '{name}', '{pattern}', '|{''.join(f'{chr(92)}{g + 1}' for g in range(gaps))}')" for i, (name, pattern, gaps) in enumerate(ruled))
    rewritten = r"trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+|\.(?:[^0-9]|$)', ' ', 'g'), ' +', ' ', 'g'))"
    for old, by in _REWRITTEN:
        rewritten = f"regexp_replace({rewritten}, '{old}', '{by}', 'g')"
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {pairs}), rule(i, name, pattern, rest) AS (VALUES {rules}),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_SPDX_LINE}', 'SPDX-License-Identifier ', 'g'), '{_SHORT}', '\1 ', 'g'), '([.!?;:])[ 	]+', '' || chr(10), 'g') AS t FROM documents)),
b AS MATERIALIZED (SELECT doc_id, i, {rewritten} AS s FROM l),
e AS (SELECT doc_id, i, 0 AS j, id FROM b JOIN known USING (s) WHERE NOT starts_with(s, '{_SPDX}')
  UNION ALL SELECT doc_id, i, j, 'spdx:' || id FROM (SELECT doc_id, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT doc_id, i, string_split_regex(regexp_replace(substr(s, {len(_SPDX) + 1}), '{_EXCEPTION}', '', 'g'), '{_JOINED}') AS ps FROM b WHERE starts_with(s, '{_SPDX}'))) JOIN known ON known.s = p AND id LIKE '%-id'
  UNION ALL SELECT doc_id, i, j, id FROM (SELECT doc_id, i, j, id, count(id) OVER (PARTITION BY doc_id, i) AS n, count(*) OVER (PARTITION BY doc_id, i) AS m FROM (SELECT doc_id, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT doc_id, i, string_split_regex(regexp_replace(s, '{_UNDER}', ''), '{_JOINED}') AS ps FROM b WHERE regexp_matches(s, '{_UNDER}') AND regexp_matches(s, '{_JOINED}') AND NOT starts_with(s, '{_SPDX}') AND s NOT IN (SELECT s FROM known)))
    LEFT JOIN known ON known.s = 'licensed under the ' || p) WHERE n = m),
f AS MATERIALIZED (SELECT doc_id, string_agg(id, '|' ORDER BY i, j) AS ids, count(*) AS n FROM e GROUP BY doc_id),
m AS (SELECT doc_id, 0 AS i, '|' || ids || '|' AS seq, []::VARCHAR[] AS names FROM f
  UNION ALL SELECT doc_id, m.i + 1, regexp_replace(seq, pattern, rest, 'g'), CASE WHEN regexp_matches(seq, pattern) THEN list_append(names, name) ELSE names END FROM m JOIN rule ON rule.i = m.i),
r AS (SELECT doc_id, list_aggregate(list_sort(list_distinct(names)), 'string_agg', ',') AS names FROM m WHERE i = {len(RULES)})
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_sentences, coalesce(replace(f.ids, '|', ' '), '') AS "sequence", coalesce(r.names, '') AS licenses
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return licenses(read(spark, sf_dir, "documents"))
