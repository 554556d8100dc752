"""Fixed values of the cleaning contract: word lists, character sets and patterns."""

# Whitespace removed by a Unicode-aware strip: U+0009-000D, 001C-0020, 0085, 00A0, 1680,
# 2000-200A, 2028, 2029, 202F, 205F and 3000.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java regex character class.
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Zero-width and no-break characters deleted by strip_invisibles.
INVISIBLE_CHARS = "\u00a0\u200b\u200c\u200d\u2060\ufeff"
LINE_BREAK_RUN = r"[\r\n\t]+"
# What counts as evidence of invisibles when rules are proposed.
INVISIBLE_EVIDENCE = "[\\r\\n\\t]|\u00a0|\u200b|\ufeff"

# Texts that stand for "no value", compared without case after a strip.
JUNK_TOKENS = ("n/a", "na", "null", "none", "nan", "-", "--", "sin dato")

# Currency codes are removed before the single symbols, so that "US$" leaves no "US" behind.
CURRENCY_CODES = ("USD", "EUR", "GBP", "U$S", "US$")
CURRENCY_SYMBOLS = ("$", "€", "£")
# An integer this long is taken for an identifier, not an amount.
IDENTIFIER_DIGITS = 13

NUMBER_EVIDENCE = r"[$€£]|,|\.|\(|%"
NUMBER_LIKE = r"^-?\p{Nd}+([.,]\p{Nd}+)?$"
EMAIL_VALID = (
    rf"^[^@{WHITESPACE_CLASS}]+@[^@{WHITESPACE_CLASS}]+\.[^@{WHITESPACE_CLASS}]+$"
)
PHONE_ALLOWED = rf"^[\p{{Nd}}{WHITESPACE_CLASS}()+\-]+$"
PHONE_DIGITS = (7, 15)

# Column-name hints (searched without case) and generated header names.
DATE_NAME_HINT = r"(fecha|date|nacimiento)"
EMAIL_NAME_HINT = r"(mail|correo)"
PHONE_NAME_HINT = r"(tel|phone|celular|whatsapp)"
AUTO_NAME = r"Columna_\d+|Unnamed:.*"
AUTO_NAME_FORMAT = "Columna_{}"

# Leading characters that make a spreadsheet evaluate a text cell.
FORMULA_PREFIX = r"^[=+\-@\t]"

MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Windows-1252 characters of the byte range 80-9F; 81, 8D, 8F, 90 and 9D are unassigned there.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNASSIGNED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)

DELIMITERS = (",", ";", "\t", "|")
BATCH_SUFFIXES = (".csv", ".xlsx", ".xls")
TEXT_SUFFIXES = (".csv",)
WORKBOOK_SUFFIXES = (".xlsx",)
MAX_WORKBOOK_BYTES = 1024 ** 3

MAX_PROPOSALS = 20
MAX_REASON_CHARS = 500
