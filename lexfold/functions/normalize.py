"""Column expressions that bring load-file values, names and dates to a common form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DC4, THORN = "\x14", "þ"

# Words read as true and false, and date formats in the order they are tried.
TRUE_WORDS = ("yes", "y", "true", "t", "1")
FALSE_WORDS = ("no", "n", "false", "f", "0")
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssZ",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
)

# Months, and hours from UTC of the zones that mail headers name.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}

# Canonical field of each load-file header, by alias.
FIELD_ALIASES = {
    "bates_begin": ["Begin Bates", "BegBates", "BEGDOC", "Bates Beg", "Bates Begin", "DocID", "Production::Begin Bates"],
    "bates_end": ["End Bates", "EndBates", "ENDDOC", "Bates End", "Production::End Bates"],
    "page_count": ["Page Count", "Pages", "PageCount", "Num Pages"],
    "text_link": ["Text Link", "Extracted Text", "OCR Path", "TextLink", "Text Path"],
    "native_link": ["Native Link", "NativeLink", "Native Path", "File Path", "Native File"],
    "custodian": ["Custodian", "Cust", "Custodian Name", "Source Custodian"],
    "source_party": ["Source Party", "Producing Party", "Party", "Production Source"],
    "date_sent": ["Date Sent", "Sent", "DateSent", "Sent Date", "Email Sent Date"],
    "date_received": ["Date Received", "Received", "DateReceived", "Received Date"],
    "date_created": ["Date Created", "Created", "DateCreated", "Creation Date", "File Created"],
    "date_modified": ["Date Modified", "Modified", "DateModified", "Last Modified", "File Modified"],
    "file_hash_md5": ["MD5", "MD5 Hash", "Hash", "MD5Hash", "MD5 Digest"],
    "file_hash_sha256": ["SHA256", "SHA-256", "SHA256 Hash", "SHA Hash"],
    "file_type": ["File Type", "FileType", "Type", "File Extension", "Extension", "Doc Type"],
    "file_name": ["File Name", "FileName", "Filename", "Original File Name", "Document Name"],
    "source_path": ["Source Path", "SourcePath", "Original Path", "Full Path", "Path"],
    "email_from": ["From", "Email From", "Author", "Sender"],
    "email_to": ["To", "Email To", "Recipients", "Recipient"],
    "email_cc": ["CC", "Email CC", "Copyee"],
    "email_bcc": ["BCC", "Email BCC", "Blind Copyee"],
    "email_subject": ["Subject", "Email Subject", "Title"],
    "family_id": ["Group Identifier", "GroupID", "Group ID", "Family Range", "Family ID", "Family", "Parent Doc ID", "Parent ID", "Attachment Parent"],
    "thread_id": ["Thread ID", "ThreadID", "Conversation Index", "Conversation ID", "Email Thread"],
    "is_inclusive": ["Inclusive Email", "Email Inclusive", "Inclusive", "Is Inclusive"],
}
STRUCTURAL = ("bates_begin", "bates_end", "page_count", "text_link", "native_link")

# Extensions of each group that a file-type filter names, and of each type that is displayed.
FILE_GROUPS = {
    "video": (".mp4", ".mov", ".avi", ".webm"),
    "audio": (".wav", ".mp3"),
    "pdf": (".pdf",),
    "office": (".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp"),
    "email": (".msg", ".eml", ".mbox", ".pst", ".ost"),
}


def header_key(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), r"(?U)[^\p{Alnum}]", "")


def bool_of(value: Column) -> Column:
    """True, False, or null when the word is neither."""
    v = F.lower(F.btrim(value))
    return F.when(v.isin(*TRUE_WORDS), True).when(v.isin(*FALSE_WORDS), False)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mail_date(value: Column) -> Column:
    """Timestamp in UTC of a mail header's date, or null: with or without weekday, seconds, zone (a name or hours and
    minutes; what is unknown is UTC) and comments in parentheses; years of two digits are 1969 to 2068."""
    form = r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3,9})[\s-]+(\d{2}|\d{4})\s+(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?\s*([A-Za-z]+|[+-]\d{4})?$"
    named = F.create_map(*(F.lit(x) for z in ZONES.items() for x in z))

    def of(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k - 1))
        number = lambda k: F.when(part(k) != "", part(k)).otherwise("0").cast("int")
        year = F.when(F.length(part(3)) == 4, number(3)).when(number(3) < 69, number(3) + 2000).otherwise(number(3) + 1900)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(2), 1, 3))).cast("int")
        zone = F.upper(part(7))
        minutes = F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int"))).otherwise(F.coalesce(F.try_element_at(named, zone) * 60, F.lit(0)))
        at = F.try_make_timestamp(year, month, number(1), number(4), number(5), number(6).cast("decimal(16,6)"))
        return F.when(month > 0, at - F.make_dt_interval(F.lit(0), F.lit(0), minutes))

    fields = lambda plain: F.split(F.regexp_replace(plain, form, "$1|$2|$3|$4|$5|$6|$7|"), r"\|")
    return _once(F.btrim(F.regexp_replace(value, r"\([^()]*\)", " ")), lambda plain: F.when(plain.rlike(form), _once(fields(plain), of)))


def utc_of(value: Column) -> Column:
    """Timestamp of the first format that fits (the session is in UTC), else of a mail date, or null; a trailing Z is +0000."""
    zoned = lambda v: F.regexp_replace(F.regexp_replace(v, "Z$", "+0000"), r"([+-]\d\d):(\d\d)$", "$1$2")
    fits = lambda v, slashes: F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in DATE_FORMATS if ("/" in f) == slashes))
    dated = lambda v: F.when(v.contains("/"), fits(v, True)).otherwise(fits(v, False))
    return _once(F.btrim(value), lambda v: F.coalesce(_once(zoned(v), dated), mail_date(v)))


def file_type_of(path: Column) -> Column:
    """Extension in lower case without its dot; null without one. Leading dots of a file name start no extension."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^\.+", "")
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ext != "", ext)


def delimiter_of(line: Column) -> Column:
    """DC4 when there is one, else the most frequent of tab, comma and pipe (earlier wins ties), else comma."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c)))
    tab, comma, pipe = count("\t"), count(","), count("|")
    return F.when(line.contains(DC4), DC4).when((tab >= comma) & (tab >= pipe) & (tab > 0), "\t").when((comma >= pipe) & (comma > 0), ",").when(pipe > 0, "|").otherwise(",")


def thorn_fields(row: Column) -> Column:
    """Fields of a DC4 row, without their thorns and outer white space."""
    return F.transform(F.split(row, DC4), lambda f: F.btrim(F.btrim(f, F.lit(THORN))))


def csv_fields(row: Column, delimiter: str) -> Column:
    """Fields of a quoted row; doubled quotes stand for one."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    raw = F.regexp_extract_all(F.concat(row, F.lit(delimiter)), F.lit(f'("(?:[^"]|"")*"|[^{d}]*){d}'), F.lit(1))
    return F.transform(raw, lambda f: F.btrim(F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)))


def bates(prefix: Column, number: Column, padding: Column) -> Column:
    """prefix and number padded with zeros; wider numbers grow."""
    n = number.cast("string")
    return F.concat(prefix, F.lpad(n, F.greatest(padding, F.length(n)), F.lit("0")))


def bates_prefix(name: Column) -> Column:
    """First word of a file name in upper case, letters and digits only, at most 12, or DOC."""
    word = F.substring(F.regexp_replace(F.upper(F.regexp_extract(F.btrim(name), r"^(\S*)", 1)), "[^A-Z0-9]", ""), 1, 12)
    return F.when(word != "", word).otherwise("DOC")


def subject_of(subject: Column) -> Column:
    """Subject without reply and forward marks, white space collapsed, in lower case."""
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^(\s*(re|fwd|fw)\s*:\s*)+", "")
    return F.lower(F.btrim(F.regexp_replace(bare, r"\s+", " ")))


def email_domain(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.substring_index(address, "@", -1)))


def event_date(value: Column) -> tuple[Column, Column]:
    """Date and precision (day, month, year, unknown) of YYYY, YYYY-MM or YYYY-MM-DD; anything else is unknown."""
    v = F.btrim(value)
    day, month, year = v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.rlike(r"^\d{4}-\d{2}$"), v.rlike(r"^\d{4}$")
    date = F.try_to_date(F.when(day, v).when(month, F.concat(v, F.lit("-01"))).when(year, F.concat(v, F.lit("-01-01"))), "yyyy-MM-dd")
    return date, F.when(date.isNull(), "unknown").when(day, "day").when(month, "month").otherwise("year")


def title_clip(text: Column, limit: int = 60) -> Column:
    """At most limit characters, cut at the last blank before, with an ellipsis when cut."""
    one = F.btrim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(one, 1, limit)
    word = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.char_length(one) <= limit, one).otherwise(F.concat(F.btrim(word), F.lit("…")))


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts and styles, tags as blanks, blanks collapsed, entities kept."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def clean_field(value: Column) -> Column:
    """A value fit for a load file: thorns, DC4 and line ends become blanks, outer blanks go; null is empty."""
    return F.btrim(F.translate(F.coalesce(value.cast("string"), F.lit("")), THORN + DC4 + "\r\n", "    "))
