"""String column helpers shared by every job.  All of them stay in the JVM."""

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import vocab

# Python's idea of white space: Unicode White_Space plus the four separators.
WS = r"\s\x1c-\x1f"
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WINDOWS_1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
ENTITY = r"&#?[A-Za-z0-9]++;"


def collapse(c: Column, also: str = "") -> Column:
    """Every run of white space becomes one space; the ends are stripped.

    ``also`` are more characters to treat as white space.  A single space is left
    alone, so ordinary words cost no replacement.
    """
    ws = WS + also
    return F.trim(F.regexp_replace(c, rf"(?U) [{ws}]++|[{ws}&&[^ ]][{ws}]*+", " "))


def strip(c: Column) -> Column:
    """Strip all white space from both ends (plain ``trim`` only knows spaces)."""
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space; stops at the first other character."""
    return c.isNull() | ~c.rlike(rf"(?U)[^{WS}]")


#: Characters of pages from common to rare, others count as rarest.  Sets the order of tests, never a result.
_COMMON = " eatoinsrl/-hdcumf.pgwybvkxjqz"
_SHARED_CHARS = 4


def _parts(words: list[str]) -> list[tuple[str, list[str]]]:
    """(part, the words that hold it), each word once: parts shared by many words first, starting with a rare character.

    A search stops at every first character of what it looks for, so a text without the part is done in one quick
    scan for all its words.
    """
    out, left = [], list(words)
    rare = lambda s: _COMMON.find(s[0]) % 100
    while left:
        parts = sorted({w[i:j] for w in left for i in range(len(w)) for j in range(i + 1, len(w) + 1)
                        if j - i >= min(_SHARED_CHARS, len(w))})
        part = max(parts, key=lambda s: (sum(s in w for w in left), rare(s), len(s)))
        out.append((part, [w for w in left if part in w]))
        left = [w for w in left if part not in w]
    return out


def contains_any(c: Column | str, words) -> Column:
    """Whether a column (or, cheaper to build, a column name) holds one of the words.

    An OR of ``contains``; a word that holds another listed word can add no hit.  Words with a common part are
    looked for only where the part is found.  ``c`` is read many times: a stored column, not an expression.
    """
    needed = [w for w in dict.fromkeys(words)
              if not any(o != w and o in w for o in words)]
    if isinstance(c, str):
        has = lambda ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"
        return F.expr("(" + " or ".join(has(ws) if ws == [part] else f"({has([part])} and {has(ws)})" for part, ws in _parts(needed)) + ")")
    any_of = lambda ws: reduce(lambda a, b: a | b, [c.contains(w) for w in ws])
    return reduce(lambda a, b: a | b, [any_of(ws) if ws == [part] else c.contains(part) & any_of(ws) for part, ws in _parts(needed)])


def count_words(c: str, words) -> Column:
    """How many of the listed words occur in a column (each counts once)."""
    return F.expr("(" + " + ".join(f"cast(contains({c}, '{w}') as int)" for w in words) + ")")


def names_of(groups, flags) -> Column:
    """Names whose flag is true, in list order."""
    return F.array_compact(F.array(*[F.when(f, F.lit(g)) for g, f in zip(groups, flags)]))


def detect_groups(c: str, groups: dict) -> Column:
    """Names of the groups with at least one word in ``c``, in group order."""
    return names_of(groups, [contains_any(c, words) for words in groups.values()])


def _decode_sql(c: str) -> str:
    # The JSON text is foldable, so the optimizer turns it into one literal map.
    table = json.dumps(vocab.ENTITIES).replace("'", "\\u0027")
    # Leading zeros don't count; 128 to 159 stand for the signs of Windows-1252, as in HTML.
    hexa, digits = "lower(substr(e, 3, 1)) = 'x'", "regexp_extract(e, '^&#[xX]?0*([0-9A-Fa-f]*);$', 1)"
    code = f"if({hexa}, try_cast(conv({digits}, 16, 10) as int), try_cast({digits} as int))"
    char = f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"
    number = f"""case when not e rlike '^&#([0-9]+|[xX][0-9A-Fa-f]+);$' then e when length({digits}) > 8 then '\ufffd'
        when {code} between 128 and 159 then substr('{WINDOWS_1252}', {code} - 127, 1)
        when {code} between 1 and 55295 or {code} between 57344 and 1114111 then {char} else '\ufffd' end"""
    # The map is searched entry by entry; most references are one of these.
    usual = " ".join(f"when e = '{e}' then r'{vocab.ENTITIES[e]}'" for e in ("&amp;", "&nbsp;", "&lt;", "&gt;", "&copy;", "&mdash;", "&ndash;", "&hellip;"))
    one = (f"case when e is null then '' when startswith(e, '&#') then {number} {usual} when e = '&quot;' then '\"' "
           f"else coalesce(try_element_at(from_json(r'{table}', 'map<string,string>'), e), e) end")
    return (f"case when contains({c}, '&') then array_join(zip_with(split({c}, '{ENTITY}', -1), "
            f"regexp_extract_all({c}, '{ENTITY}', 0), (t, e) -> concat(t, {one})), '') else {c} end")


def decode_entities(column: str) -> Column:
    """Character references of a stored column to characters, in a single pass.

    One SQL text instead of some fifty column calls; nothing is decoded twice.
    """
    return F.expr(_decode_sql(column))


def decode_all(column: str, depth: int = 1) -> Column:
    """``decode_entities`` for every string of a stored array, nested ``depth`` times."""
    sql = _decode_sql("v0")
    for level in range(depth):
        outer = column if level == depth - 1 else f"v{level + 1}"
        sql = f"transform({outer}, v{level} -> {sql})"
    return F.expr(sql)


def exploded_rows(df: DataFrame, column: str) -> DataFrame:
    """One row per entry of ``column`` as pos and item; the column itself goes.

    A plain explode makes the optimizer add a ``size > 0`` filter and push it below
    the projections, which works the whole column out twice.  The outer form does not.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode_outer(column).alias("pos", "item")).where("pos is not null")
