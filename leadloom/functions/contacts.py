"""E-mail addresses and phone numbers out of page columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import vocab
from leadloom.functions.text import strip

# The address, the obfuscated address and the phone number that count, in the forms below.
_LOCAL = r"a-zA-Z0-9._%+-"
# A match can only start where a run of address characters starts, or right after
# the previous match.  Saying so keeps long character runs linear.
_RUN = rf"(?:\G|(?<![{_LOCAL}]))"
EMAIL = rf"{_RUN}[{_LOCAL}]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"
OBFUSCATED = (rf"(?iU){_RUN}([{_LOCAL}]++)\s*(?:\[at\]|\(at\)|\sat\s)\s*"
              r"([a-zA-Z0-9.-]+)\s*(?:\[dot\]|\(dot\)|\sdot\s)([a-zA-Z]{2,})")
# The look-ahead only spares the other tests at characters no number starts with.
PHONE = r"(?U)(?=[+(\d])(?<!\d)((?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4})(?!\d)"


def valid_email(e: Column) -> Column:
    """One @, a local part, a dot in the domain, and no domain of the ghost list."""
    domain = F.substring_index(e, "@", -1)
    ghost = reduce(lambda a, b: a | b, [
        (domain == g) | domain.endswith("." + g) for g in vocab.GHOST_DOMAINS])
    return ((F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit(""))) == 1)
            & ~e.startswith("@") & domain.contains(".") & ~ghost)


def toll_free(phone: Column) -> Column:
    digits = F.regexp_replace(phone, "[^0-9]", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"),
                      F.substring(digits, 2, 10)).otherwise(digits)
    return (F.length(national) >= 10) & F.substring(national, 1, 3).isin(vocab.TOLL_FREE)


def mailto_emails(hrefs: Column) -> Column:
    """Valid addresses of ``mailto:`` links."""
    links = F.filter(F.transform(hrefs, strip), lambda h: F.lower(h).startswith("mailto:"))
    addresses = F.transform(links, lambda h: F.lower(strip(
        F.substring_index(F.substring(h, F.lit(8), F.length(h)), "?", 1))))
    return F.array_distinct(F.filter(addresses, valid_email))


def scan_emails(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)), F.lower)
    return F.when(c.contains("@"), found).otherwise(F.expr("cast(array() as array<string>)"))


def obfuscated_emails(c: Column) -> Column:
    """Addresses written with at/dot words; rebuilt from the three parts of a match."""
    whole = F.regexp_extract_all(c, F.lit(OBFUSCATED), F.lit(0))
    part = lambda m, i: F.regexp_extract(m, OBFUSCATED, i)
    found = F.transform(whole, lambda m: F.lower(F.concat(
        part(m, 1), F.lit("@"), part(m, 2), F.lit("."), part(m, 3))))
    return F.when(F.lower(c).contains("dot"), found).otherwise(
        F.expr("cast(array() as array<string>)"))


def high_first(high: Column, rest: Column) -> Column:
    """Sorted high-confidence values, then the sorted others."""
    return F.concat(F.array_sort(F.array_distinct(high)), F.array_sort(F.array_except(rest, high)))


def tel_phones(hrefs: Column) -> Column:
    """Numbers of ``tel:`` links as written; empty and toll-free ones dropped."""
    links = F.filter(F.transform(hrefs, strip), lambda h: F.lower(h).startswith("tel:"))
    numbers = F.transform(links, lambda h: strip(F.substring(h, F.lit(5), F.length(h))))
    return F.array_distinct(F.filter(numbers, lambda p: (p != "") & ~toll_free(p)))


def text_phones(text: Column) -> Column:
    """US numbers in running text; toll-free ones dropped, spellings kept apart."""
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda p: ~toll_free(p)))
