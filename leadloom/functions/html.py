"""HTML to columns with regular expressions the JVM runs inside codegen stages.

Loops over attributes use possessive quantifiers: Java runs those iteratively,
so long tags can neither overflow the stack nor backtrack.

Callers build a page in steps (one ``select`` each) because most helpers use
their input more than once and want it stored.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import WS, collapse, strip

MARK = "\u0001"  # stands where a tag or a removed element was
# A quote opens a value only right after "="; anywhere else it is an ordinary character.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'])))*+"""
TAG = rf"<[!?/a-zA-Z]{ATTRS}>"
CODE = (r"(?is)<(?:!--.*?(?:-->|\z)"
        rf"|(script|style|template)(?=[\s/>]){ATTRS}>.*?(?:</\1\s*+>|\z))")
_ELEMENT = r"(?is)<({names})(?=[\s/>])" + ATTRS + r"(?<!/)>.*?</\1\s*+>"
NOSCRIPT_SVG = _ELEMENT.format(names="noscript|svg")
IFRAME = _ELEMENT.format(names="iframe")

_SKIP_ATTR = r"""(?:(?!{name}[\s=>/]|{name}$)[^\s>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+[\s/]*+)*+"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_HIDDEN_ATTR = (
    r"""(?i:\sstyle\s*=\s*(?:"[^">]*?display *: *none[^"]*"|'[^'>]*?display *: *none[^']*'|display:none[^\s>]*))"""
    r"""|\s(?i:aria-hidden)\s*=\s*(?:"true"|'true'|true(?=[\s>]))""")
HIDDEN_OPEN = rf"""(?s)^<[a-zA-Z](?=[^>]*?(?:{_HIDDEN_ATTR}))"""
HIDDEN_ANY = rf"""(?s)<[a-zA-Z](?=[^>]*?(?:{_HIDDEN_ATTR}))"""
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"]
# What HTML ends without a close tag.
ENDS_PARAGRAPH = ["address", "article", "aside", "blockquote", "center", "div", "dl", "fieldset", "footer", "form", "h1", "h2",
                  "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
SIBLINGS = [["li"], ["dt", "dd"], ["option"], ["tr"], ["td", "th"]]


def drop_code(html: Column) -> Column:
    """Without comments and without script, style and template elements."""
    return F.regexp_replace(html, CODE, MARK)


def drop_noscript_svg(c: Column, low: Column) -> Column:
    """``low`` is the whole page in lower case: a cheap look spares most pages the scan."""
    return F.when(low.contains("<noscript") | low.contains("<svg"),
                  F.regexp_replace(c, NOSCRIPT_SVG, MARK)).otherwise(c)


def drop_iframe(c: Column, low: Column) -> Column:
    return F.when(low.contains("<iframe"), F.regexp_replace(c, IFRAME, MARK)).otherwise(c)


def hidden_tokens(c: Column, low: Column) -> Column:
    """Tags and texts in order, of pages that may have a hidden element; null for all others (most)."""
    maybe = low.contains("display") | low.contains("aria-hidden")
    return F.when(maybe & c.rlike(HIDDEN_ANY), F.regexp_extract_all(c, F.lit(rf"(?s){TAG}|[^<]++|<"), F.lit(0)))


def token_kinds(tokens: str) -> Column:
    """For each token of a stored array: lower-case tag name, kind (1 opens, 2 closes, 0 neither) and whether it hides."""
    def kind(t):
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
        alone = t.endswith("/>") | name.isin(VOID)
        return F.when(~t.startswith("<") | (name == ""), F.struct(F.lit("").alias("tag"), F.lit(0).alias("kind"), F.lit(False).alias("hides"))).otherwise(
            F.struct(name.alias("tag"), F.when(t.startswith("</"), 2).when(alone, 0).otherwise(1).alias("kind"),
                     (~alone & t.rlike(HIDDEN_OPEN)).alias("hides")))
    return F.transform(tokens, kind)


def shown_spans(kinds: str) -> Column:
    """(first token, number of tokens) of the stretches outside elements hidden by an inline style or ``aria-hidden="true"``.

    One pass over a stored array with the names of the open elements.  An element ends at its close tag, at that of
    an element around it, or where HTML ends it without one (a paragraph before a block, an item before the next).
    """
    names = lambda words: ", ".join(f"'{w}'" for w in words)
    top = "s.stack[size(s.stack) - 1]"
    implied = (f"(size(s.stack) > 0 and (({top} = 'p' and k.tag in ({names(ENDS_PARAGRAPH)}))"
               + "".join(f" or ({top} in ({names(g)}) and k.tag in ({names(g)}))" for g in SIBLINGS) + "))")
    popped = f"""case when k.kind = 1 and {implied} then 1 when k.kind = 2
        then cast(array_position(reverse(s.stack), k.tag) as int) else 0 end"""
    left = f"(size(s.stack) - {popped})"
    # ``at`` is the place of the hidden element among the open ones, 0 outside.
    ended = f"(s.at > 0 and {left} < s.at)"
    start = f"if({ended}, if(k.kind = 1, s.i, s.i + 1), s.start)"
    hides = f"(k.hides and (s.at = 0 or {ended}))"
    # Only the stack is small: the spans are carried as they are and grow by hidden elements alone.
    step = f"""named_struct('i', s.i + 1, 'start', {start},
        'at', case when {hides} then {left} + 1 when {ended} then 0 else s.at end,
        'stack', case k.kind when 0 then s.stack when 1 then concat(slice(s.stack, 1, {left}), array(k.tag))
            else slice(s.stack, 1, {left}) end,
        'spans', if({hides}, concat(s.spans, array(named_struct('a', {start}, 'n', s.i - {start}))), s.spans))"""
    begin = """named_struct('i', 1, 'start', 1, 'at', 0, 'stack', cast(array() as array<string>),
        'spans', cast(array() as array<struct<a:int,n:int>>))"""
    return F.expr(f"""aggregate({kinds}, {begin}, (s, k) -> {step}, s -> if(s.at > 0, s.spans,
        concat(s.spans, array(named_struct('a', s.start, 'n', s.i - s.start)))))""")


def shown(c: Column, tokens: str, spans: str) -> Column:
    """The page without hidden elements; ``c`` itself where nothing is hidden."""
    kept = F.array_join(F.transform(spans, lambda p: F.array_join(F.slice(tokens, p["a"], p["n"]), "")), MARK)
    return F.coalesce(kept, c)


def tags_to_marks(c: Column) -> Column:
    return F.regexp_replace(c, TAG, MARK)


def joined_text(c: Column) -> Column:
    """Text nodes stripped and joined by one space; inner white space is kept.

    ``c`` has marks for tags and is entity-decoded.
    """
    return strip(F.regexp_replace(c, rf"(?U)[{WS}]*+{MARK}[{WS}{MARK}]*+", " "))


def flat_text(c: Column) -> Column:
    """As ``joined_text`` with all white space collapsed."""
    return collapse(c, MARK)


def attribute(attrs: Column, name: str) -> Column:
    """Raw value of an attribute ('' when absent or bare); the first one wins.

    ``attrs`` is the text between the tag name and ``>``.
    """
    v = F.regexp_extract(
        attrs, rf"(?is)^[\s/]*+{_SKIP_ATTR.format(name=name)}{name}\s*+=\s*+{_VALUE}", 1)
    return F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2")


def has_attribute(attrs: Column, name: str) -> Column:
    return attrs.rlike(rf"(?is)^[\s/]*+{_SKIP_ATTR.format(name=name)}{name}(?:[\s=/]|$)")


def elements(c: Column, name: str, low: Column | None = None) -> Column:
    """``<name ...>content`` of every such element, in document order.

    With ``low``, the page in lower case, pages without the element are not scanned.
    """
    stop = rf"</{name}\s*+>|<{name}[\s/>]|\z" if name == "a" else rf"</{name}\s*+>|\z"
    found = F.regexp_extract_all(
        c, F.lit(rf"(?is)<{name}(?=[\s/>]){ATTRS}>(?:.*?)(?={stop})"), F.lit(0))
    return found if low is None else F.when(low.contains(f"<{name}"), found).otherwise(
        F.expr("cast(array() as array<string>)"))


def open_tags(c: Column, names: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?i)<(?:{names})(?=[\s/>]){ATTRS}>"), F.lit(0))


def attrs_of(tag: Column) -> Column:
    """Attribute text of the open tag that ``tag`` starts with."""
    return F.regexp_extract(tag, rf"(?s)^<[a-zA-Z][a-zA-Z0-9]*+({ATTRS})>", 1)


def content_of(element: Column) -> Column:
    return F.regexp_replace(element, rf"(?s)^<[a-zA-Z]{ATTRS}>", "")


def marked_contents(element_array: Column) -> Column:
    """Content of each element with marks for tags; next come decoding and ``joined_text``."""
    return F.transform(element_array, lambda e: tags_to_marks(content_of(e)))


def raw_values(element_array: Column, name: str) -> Column:
    """Attribute value of each element, not decoded yet."""
    return F.transform(element_array, lambda e: attribute(attrs_of(e), name))
