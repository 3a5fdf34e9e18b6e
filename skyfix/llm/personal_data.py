"""Personal data: base formats, and boosted trees over high-recall candidates.

Base spans are exact formats (e-mail, ip, card, phone) and always stay. Further kinds
(local phone numbers, identity numbers, accounts, secrets, spelled-out e-mails) come from
generators that propose too much, also overlapping spans; boosted trees score each
candidate by its format and the words around it, and a threshold per kind, calibrated on
held-out rows, selects those that are redacted. Everything is DataFrame functions: the
trees are CASE expressions over a column of features. ``training/train_personal_data.py``
fits them on a bounded sample of labelled, generated rows.

Candidates wholly inside a base span go; those above their threshold that overlap each other
become one span over all of them, with the kind of the best score, so nothing that was
selected stays in the text.

Places are code points, end exclusive. A match's place is the length of the pieces and
matches before it, as ``split`` and ``regexp_extract_all`` give them for one pattern. Such
running sums and maxima are made in chunks of chunks (``scan``), so that time grows with the
text; possessive quantifiers keep long runs linear where they can't change the match.

Defined results: a null text is empty and has no spans; repeated rows stay; rows with a
null id are searched like any other; other columns are ignored by ``find_spans`` and kept
by ``redact``.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns

LOCAL = "A-Za-z0-9._%+-"
#: Base kinds, in the order that breaks ties, with what a text must hold to be searched.
BASE = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "digits"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "digits"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "digits and contains(text, '+')"),
}
#: What the formats leave open, over the matched text ``x.t``; failing matches go.
DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + case when (length(d) - i) % 2 = 0 then cast(substr(d, i, 1) as int)"
    " else element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(d, i, 1) as int) + 1) end) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(right(p, 3) as int), 0) <= 255)",
    "card": f"length({DIGITS}) between 14 and 19 and forall(array({DIGITS}), d -> {LUHN})",
    "phone": f"length({DIGITS}) between 10 and 15",
}
#: Generators of candidates: kind, pattern, condition on the text.
GENERATORS = {
    "phone_local": (r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,}+[A-Za-z]?+", "digits"),
    "national_id": (r"(?<![0-9A-Za-z.\-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z\-])", "digits"),
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![0-9A-Za-z])", "digits"),
    "secret": (r"(?<![A-Za-z0-9_\-+/])(?=[A-Za-z_\-+/]*+[0-9])[A-Za-z0-9_\-+/]{16,}+={0,2}+", "digits"),
    "email_spelled": (rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]\x20?(?:dot|DOT)\x20?[\])]|\.)\x20?[A-Za-z0-9-]++)++", "text rlike '[\\\\[(] ?(at|AT)'"),
}
#: What a pattern takes along only to be ruled out by it: a letter right behind a number.
RULED_OUT = {"phone_local": "x.t rlike '[A-Za-z]$'"}
#: Words before a candidate that speak for a kind of data.
CUES = {
    "cue_phone": r"(?i)(phone|tel|call|mobile|cell|fax|whatsapp|dial|sms|number)",
    "cue_identity": r"(?i)(ssn|social|security|passport|national|licen[cs]e|identity|tax)",
    "cue_account": r"(?i)(iban|account|bank|transfer|card|payment|swift)",
    "cue_secret": r"(?i)(token|secret|passw|api|key|credential|auth|bearer)",
    "cue_reference": r"(?i)(isbn|order|invoice|page|version|serial|part|sku|issue|commit|checksum|sha|md5|http|www|figure|table)",
}
CONTEXT = 24
#: Features, over a candidate ``x`` (text ``t``, context ``before``, kind ``k``).
FEATURES = {
    "kind": "x.k",
    "n_digits": f"length({DIGITS})",
    "n_letters": "length(regexp_replace(x.t, '[^A-Za-z]', ''))",
    "n_other": "length(regexp_replace(x.t, '[A-Za-z0-9]', ''))",
    "n_groups": "regexp_count(x.t, '[0-9]+')",
    "n_slashes": "length(regexp_replace(x.t, '[^/]', ''))",
    "n_changes": "regexp_count(x.t, '[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])')",
    "n_kinds": "size(array_distinct(split(x.t, '')))",
    "brackets": "cast(x.t rlike '^[(][0-9]+[)]' as int)",
    "dated": "cast(x.t rlike '(^|[^0-9])(19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](19|20)[0-9]{2}' as int)",
    "assigned": "cast(x.before rlike '[=:] ?[\"\\']?$' as int)",
    "in_path": "cast(x.before rlike '[/.@#=&?]$' as int)",
    **{name: f"cast(x.before rlike '{pattern}' as int)" for name, pattern in CUES.items()},
}
#: Code points of a piece that ``redact`` cuts a text into.
PIECE = 1024
MODEL = Path(__file__).parent / "models" / "personal_data.json"


#: Elements that a fold gathers into one array, which it copies for each.
CHUNK = 64


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(values: str, add: bool, level: int = 3) -> str:
    """What an array's earlier elements give for each of its elements: their sum or greatest,
    0 for the first. Chunks are folded apart and then moved on by what the chunks before give."""
    join = (lambda a, b: f"{a} + {b}") if add else (lambda a, b: f"greatest({a}, {b})")
    fold = (
        "aggregate({}, named_struct('at', 0, 'out', cast(array() as array<int>)),"
        f" (a, y) -> named_struct('at', {join('a.at', 'y')}, 'out', concat(a.out, array(a.at))), a -> a.out)"
    )
    if not level:
        return fold.format(values)
    v, c = f"v{level}", f"c{level}"
    chunks = f"transform(sequence(0, (size({v}) - 1) div {CHUNK}), i -> transform(sequence(i * {CHUNK}, least(i * {CHUNK} + {CHUNK}, size({v})) - 1), j -> {v}[j]))"
    whole = f"transform({c}, q -> aggregate(q, 0, (a, y) -> {join('a', 'y')}))"
    moved = f"flatten(zip_with(transform({c}, q -> {fold.format('q')}), {scan(whole, add, level - 1)}, (q, t) -> transform(q, y -> {join('y', 't')})))"
    return _let(values, v, f"case when size({v}) <= {CHUNK} then {fold.format(v)} else {_let(chunks, c, moved)} end")


def _merged(spans: str, first: str) -> str:
    """Spans, sorted by start, that overlap become one each: ``s, e`` and what ``first`` makes of
    the run ``r`` of spans."""
    flags = f"zip_with(v, {scan('transform(v, x -> x.e)', False)}, (x, m) -> x.s >= m)"
    begins = f"filter(transform({flags}, (f, i) -> if(f, i, -1)), i -> i >= 0)"
    run = "transform(sequence(b[i], if(i + 1 < size(b), b[i + 1], size(v)) - 1), j -> v[j])"
    made = _let(run, "r", f"named_struct('s', r[0].s, 'e', array_max(transform(r, x -> x.e)), {first})")
    return _let(spans, "v", f"transform({_let(begins, 'b', f'transform(b, (unused, i) -> {made})')}, x -> x)")


def _matches(pattern: str, where: str, k: int) -> Column:
    """Matches of one pattern: array of ``s, e, k, t, before``."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    kind = "array<struct<s:int,e:int,k:int,t:string,before:string>>"
    found, pieces = f"regexp_extract_all(text, '({quoted})', 1)", f"split(text, '{quoted}', -1)"
    rows = f"filter(zip_with({found}, {pieces}, (t, p) -> named_struct('t', t, 'p', length(p), 'n', length(t), 'before', right(p, {CONTEXT}))), x -> x.t is not null)"
    span = f"named_struct('s', at + x.p, 'e', at + x.p + x.n, 'k', {k}, 't', x.t, 'before', x.before)"
    placed = _let(rows, "w", f"zip_with(w, {scan('transform(w, x -> x.p + x.n)', True)}, (x, at) -> {span})")
    return F.expr(f"case when {where} then {placed} else cast(array() as {kind}) end")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("digits", F.col("text").rlike("[0-9]"))


def with_base(rows: DataFrame) -> DataFrame:
    """Adds one column of valid spans per base kind."""
    for k, (kind, (pattern, where)) in enumerate(BASE.items()):
        rows = rows.withColumn(f"b_{kind}", _matches(pattern, where, k))
        if VALID[kind] != "true":
            rows = rows.withColumn(f"b_{kind}", F.expr(f"filter(b_{kind}, x -> {VALID[kind]})"))
    return rows


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``base``, the valid base spans, and ``candidates``: all generators' spans with their
    ``f`` of features, but for those wholly inside a base span."""
    for k, (kind, (pattern, where)) in enumerate(GENERATORS.items()):
        rows = rows.withColumn(f"g_{kind}", _matches(pattern, where, k))
        if kind in RULED_OUT:
            rows = rows.withColumn(f"g_{kind}", F.expr(f"filter(g_{kind}, x -> not {RULED_OUT[kind]})"))
    base = F.concat(*[f"b_{k}" for k in BASE])
    rows = rows.withColumn("base", base).withColumn("proposed", F.concat(*[f"g_{k}" for k in GENERATORS])).drop(*[f"g_{k}" for k in GENERATORS])
    # By start, base spans first: one that began no later and ends no earlier holds the candidate.
    order = "sort_array(concat(transform(base, x -> named_struct('s', x.s, 'o', -1, 'e', x.e, 'x', x)), transform(proposed, (x, i) -> named_struct('s', x.s, 'o', i, 'e', x.e, 'x', x))))"
    reach = scan("transform(w, y -> if(y.o < 0, y.e, 0))", False)
    outside = _let(order, "w", f"zip_with(w, {reach}, (y, m) -> if(y.o >= 0 and m < y.e, y.x, null))")
    rows = rows.withColumn("candidates", F.expr(f"case when size(proposed) > 0 then filter({outside}, x -> x is not null) else proposed end")).drop("proposed")
    made = ", ".join(f"'{n}', {e}" for n, e in FEATURES.items())
    return rows.withColumn("candidates", F.expr(f"transform(candidates, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 't', x.t, 'f', named_struct({made})))"))


def _tree(node: dict) -> str:
    if "value" in node:
        return repr(node["value"]) + "D"
    return f"case when x.f.{node['feature']} <= {node['at']} then {_tree(node['low'])} else {_tree(node['high'])} end"


def score_sql(model: dict) -> str:
    return f"{model['start']!r}D + " + " + ".join(f"({_tree(t)})" for t in model["trees"])


def load_model() -> dict:
    return json.loads(MODEL.read_text())


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``doc_id``; an array ``s, e`` per base kind; ``base`` and ``spans``: arrays of
    ``s, k, e, kind`` by start, then kind (base kinds first, as listed)."""
    model = model or load_model()
    rows = with_candidates(with_base(_texts(df, id_col, text_col))).drop("text", "digits")
    rows = rows.withColumn("candidates", F.expr(f"transform(candidates, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'score', {score_sql(model)}))"))
    limit = "element_at(array(" + ", ".join(f"{model['thresholds'][k]!r}D" for k in GENERATORS) + "), x.k + 1)"
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in (*BASE, *GENERATORS)) + "), {} + 1)"
    plain = f"x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', {names.format('x.k')})"
    more = f"x -> named_struct('s', x.s, 'k', x.k + {len(BASE)}, 'e', x.e, 'kind', {names.format(f'x.k + {len(BASE)}')})"
    best = "'k', array_max(transform(r, x -> named_struct('score', x.score, 'k', -x.k))).k * -1"
    rows = rows.withColumn("base", F.expr(f"sort_array(transform(base, {plain}))"))
    rows = rows.withColumn("chosen", F.expr(f"filter(candidates, x -> x.score > {limit})"))
    rows = rows.withColumn("added", F.expr(f"transform(case when size(chosen) > 0 then {_merged('chosen', best)} else cast(array() as array<struct<s:int,e:int,k:int>>) end, {more})"))
    return rows.select("doc_id", *[F.col(f"b_{k}").alias(k) for k in BASE], "base", F.sort_array(F.concat("base", "added")).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def redact(df: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in brackets; overlapping
    spans become one, named by the first. Texts without spans, and nulls, stay as they are."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_key"), F.col(f"`{text_col}`").alias("_text"))
    found = find_spans(keyed, "_key", "_text", model)
    text = f"doc_id.`{text_col}`"
    # A place in a long string is found by counting, so what stays is taken from short pieces.
    pieces = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"
    part = f"substr(p[j], greatest(x.a - j * {PIECE}, 0) + 1, least(x.b - j * {PIECE}, {PIECE}) - greatest(x.a - j * {PIECE}, 0))"
    between = f"if(x.b > x.a, array_join(transform(sequence(x.a div {PIECE}, (x.b - 1) div {PIECE}), j -> {part}), ''), '')"
    gaps = f"transform(sequence(0, size(m)), i -> named_struct('a', if(i > 0, m[i - 1].e, 0), 'b', if(i < size(m), m[i].s, length({text})), 'kind', if(i < size(m), concat('[', upper(m[i].kind), ']'), '')))"
    cleaned = f"array_join(transform({gaps}, x -> concat({between}, x.kind)), '')"
    new = _let(_merged("spans", "'kind', r[0].kind"), "m", _let(pieces, "p", cleaned))
    new = F.when(F.size("spans") > 0, F.expr(new)).otherwise(F.expr(text))
    return found.select(*[new.alias(c) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in df.columns])
