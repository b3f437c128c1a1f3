"""Pattern catalogues and the chains that fold them over a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import col, collapse_blanks, let

#: Personal data by kind.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
#: Phrases of a light cleaning.
LIGHT_DISCLAIMERS = (
    r"(?is)this (?:e-?mail|message)(?: and any attachments?)? (?:is|are|may be|contains?) [^.]*(?:confidential|privileged|intended).*",
    r"(?is)if you (?:are not the intended recipient|have received this).*",
    r"(?is)confidentiality notice.*",
    r"(?is)the information (?:contained )?in this (?:e-?mail|message).*",
)
#: Phrases of promotions of a light cleaning.
LIGHT_PROMOTIONS = (r"(?i)click here[^.\n]*", r"(?i)unsubscribe[^.\n]*", r"(?i)to (?:opt out|be removed)[^.\n]*", r"(?i)special offer[^.\n]*", r"(?i)limited time[^.\n]*", r"(?i)visit our web ?site[^.\n]*", r"(?i)all rights reserved[^.\n]*")
#: Forward lines of a light cleaning.
LIGHT_FORWARDS = (r"(?im)^-+ ?(?:original|forwarded) message ?-+.*$", r"(?im)^(?:begin )?forwarded (?:message|by).*$")
#: Families of boilerplate in mails, each pattern with a word or sign that any text it fits must hold in lower case ("" if there is none).
DISCLAIMERS = (
    ("disclaimer:", r"(?is)(disclaimer:.*?)(?=\n[A-Z]|$)"),
    ("notice:", r"(?is)(confidential(ity)? notice:.*?)(?=\n[A-Z]|$)"),
    ("legal notice:", r"(?is)(legal notice:.*?)(?=\n[A-Z]|$)"),
    ("if you are not", r"(?is)(if you are not the intended recipient.*?)(?=\n[A-Z]|$)"),
    ("privileged and", r"(?is)(privileged and confidential.*?)(?=\n[A-Z]|$)"),
    ("is intended only", r"(?is)(this (e-?)?mail (message )?is intended only for.*?)(?=\n[A-Z]|$)"),
    ("this communication", r"(?is)(this communication is intended solely for.*?)(?=\n[A-Z]|$)"),
    ("this message", r"(?is)(this message contains confidential information.*?)(?=\n[A-Z]|$)"),
    ("please do not", r"(?is)(please do not reply to this email.*?)(?=\n[A-Z]|$)"),
    ("this email may", r"(?is)(this email may contain.*?confidential.*?)(?=\n[A-Z]|$)"),
    ("the information", r"(?is)(the information (contained )?in this (e-?)?mail.*?)(?=\n[A-Z]|$)"),
    ("this message", r"(?is)(this message is for the designated recipient.*?)(?=\n[A-Z]|$)"),
)
#: Phrases of promotions.
PROMOTIONS = (
    ("follow us", r"(?is)follow us on [\w\s]+"),
    ("like us", r"(?is)like us on [\w\s]+"),
    ("connect with", r"(?is)connect with us on [\w\s]+"),
    ("subscribe", r"(?is)subscribe( to)? [\w\s]+"),
    ("unsubscrib", r"(?is)unsubscrib(e|ing|tion).*?(\.|$)"),
    ("in your browser", r"(?is)view (this|it) in your browser.*?(\.|$)"),
    ("visit our", r"(?is)visit our website.*?(\.|$)"),
    ("sent from my", r"(?is)sent from my (iphone|ipad|android|smartphone|blackberry|mobile device).*?(\.|$)"),
    ("download our", r"(?is)download our app.*?(\.|$)"),
    ("get it on", r"(?is)get it on (the app store|google play).*?(\.|$)"),
    ("having trouble", r"(?is)having trouble viewing this email\?.*?(\.|$)"),
    ("to ensure", r"(?is)to ensure delivery to your inbox.*?(\.|$)"),
    ("to stop", r"(?is)to stop receiving (these|our) emails.*?(\.|$)"),
    ("click here", r"(?is)click here to (view|update).*?(\.|$)"),
    ("this email because", r"(?is)you( are)? receiv(ed|ing) this email because.*?(\.|$)"),
    ("this email was", r"(?is)this email was sent by.*?(\.|$)"),
)
#: What begins or makes a signature.
SIGNATURES = (
    ("--", r"(?im)^--+\s*\n[\s\S]*$"),
    ("regards,", r"(?im)^regards,[\s\S]*$"),
    ("sincerely,", r"(?im)^sincerely,[\s\S]*$"),
    ("best", r"(?im)^best( regards)?[\s\S]*$"),
    ("thanks", r"(?im)^thanks(,| & regards|\s*\n)[\s\S]*$"),
    ("cheers,", r"(?im)^cheers,[\s\S]*$"),
    ("", r"(?im)\n\d+ [A-Za-z]+ (avenue|street|road|lane|drive|place|blvd)[\s\S]*?\n[A-Za-z]+, [A-Z]{2} \d{5}"),
    ("", r"(?im)\n(tel|phone|mobile|fax): [\d\-\+\.]+(\n|$)"),
    ("email:", r"(?im)\nemail: [^\s@]+@[^\s@]+\.[^\s@]+(\n|$)"),
    ("confidential", r"(?im)this (email|e-mail) (and any attachments)?.*confidential"),
    ("warm regards,", r"(?im)^warm regards,[\s\S]*$"),
    ("kind regards,", r"(?im)^kind regards,[\s\S]*$"),
    ("yours", r"(?im)^yours (truly|sincerely),[\s\S]*$"),
    ("all the best,", r"(?im)^all the best,[\s\S]*$"),
)
#: References to attachments.
ATTACHMENTS = (
    ("- ", r"(?im)^\s*- .*?\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|txt)$"),
    ("[attachment:", r"(?im)\[attachment:.*?\]"),
    ("<attached:", r"(?im)<attached:.*?>"),
    ("see attached", r"(?im)see attached( file)?[:\.]"),
)
#: Headers of forwarded mails.
FORWARDS = (
    ("---", r"(?i)^-{3,}[\s\S]*?forwarded[^\n]*\n"),
    ("subject:", r"(?i)^from:.*?sent:.*?to:.*?subject:.*?\n"),
    ("wrote:", r"(?i)^on.*?wrote:.*?\n"),
    ("from:", r"(?i)^_+[\s\S]*?from:.*?\n"),
    ("forwarded by", r"(?i)-{3,}\s*forwarded by[\s\S]*?-{3,}"),
    ("original message", r"(?i)\s*original message\s*[\s\S]*?subject:.*?\n"),
    ("forwarded by", r"(?i)forwarded by.*?on.*?\n"),
    ("begin forwarded", r"(?i)begin forwarded message:[\s\S]*?\n>"),
    ("forwarded by", r"(?i)\n-{3,}\s*forwarded by[\s\S]*?\n"),
    ("from:", r"(?i)>\s*from:.*?\n>\s*sent:.*?\n>\s*to:.*?\n>\s*subject:.*?\n"),
)
#: Marks of one mail system.
LAYOUT = (
    ("@", r"(?i)\t[A-Za-z ]+@[A-Za-z]+\n\t\d{2}/\d{2}/\d{4} \d{2}:\d{2} (am|pm)(\n\t\t[\s\S]*?)+?(?=\n\n)"),
    ("\t", r"(?i)(\t+[^\n]*\n){2,}"),
    ("/ect@ect", r"(?i)[A-Za-z]+ [A-Za-z]+/[A-Z]{3}/ect@ect"),
    ("\t\t ", r"(?i)\t\t (to|cc|subject|fw): .*?\n"),
    ("please respond", r"(?i)please respond to.*?\n"),
)
#: Header lines. The first two patterns are one, as the source of the list writes them.
HEADERS = (
    ("<", r"(?im)^.*?(to|cc|bcc|from|subject|fw|re|sent|date|message-id):?.*$\n?^.*?<.*?>.*$\n?"),
    ("@", r"(?im)^.*?@.*$\n?"),
    (">", r"(?im)^>.*$\n?"),
    (":", r"(?im).*?(wrote|says):.*$\n?"),
    ("/", r"(?im)^.*?\d{2}/\d{2}/\d{4}.*$\n?"),
    ("<", r"<[^>]*>"),
    ("[", r"\[.*?\]"),
    ("", r"(?i)(to|cc|bcc|from|subject|fw|re)(\s*:|\s+)"),
    ("@", r"[\w\.-]+@[\w\.-]+\.\w+"),
)
#: Words that begin a line of metadata, eight patterns in one so that lines are looked at once.
CSV_LINES = (("", r"(?im)^(?:Message-ID|Date|From|To|Cc|Subject|Content-Type|Folder).*$"),)
#: Personal data of the full cleaning.
PRIVATE = (
    ("@", r"(?im)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("@", r"(?im)<[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}>"),
    ("", r"(?im)\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("+", r"(?im)\+\d{1,3}[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"),
    (":", r"(?im)(^|\n)(to|cc|bcc|from|subject|date|sent):.*?(\n|$)"),
    ("-", r"(?im)\d{3}-\d{2}-\d{4}"),
)
#: Links, and signs that any link holds.
BARE_URL = r"""(?i)(https?://[^\s<>"]+|www\.[^\s<>"]+|[^\s<>"]+\.(com|org|net|edu|gov)(\/[^\s<>"]*)?)"""
URL_SIGNS = r"https?://|www\.|\.(?:com|org|net|edu|gov)"
#: Numbers, dates and times.
NUMBERS = (
    ("", r"(\+\d{1,3}[-\.\s]?)?(\(?\d{3}\)?[-\.\s]?)?\d{3}[-\.\s]?\d{4}"),
    ("", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    (":", r"(?i)\b\d{1,2}:\d{2}(:\d{2})?\s*(am|pm)?\b"),
    ("", r"\b\d+\b"),
)
#: Signs that become blanks.
SEPARATORS = r"[_\-=*:;&\[\]?!|]"
#: Marks at which a forwarded part begins.
FORWARD_MARKS = ("forwarded message", "forwarded by", "original message", "begin forwarded message:")
#: Greetings and other words that a word count of mails leaves out, then signs.
GREETINGS = (
    r"(?i)Dear\s+\w+[,.]?", r"(?i)(Best\s+)?Regards[,.]?", r"(?i)Sincerely[,.]?", r"(?i)Thank\s+you", r"(?i)Thanks", r"(?i)Hi\s+\w+[,.]?", r"(?i)Hello\s+\w+[,.]?",
    r"\S+@\S+\.\S+", r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}",
)
#: What begins metadata.
METADATA = r"(?is)(?:Sent|To|From|Cc):.*"
#: Patterns of the light cleaning of encyclopaedia texts, with their replacements.
WIKI = (
    (r"\[[0-9]+\]", ""), (r"\[(?:citation needed|edit|who\?|when\?)\]", ""), (r"[0-9]+°[0-9]+′[NS] [0-9]+°[0-9]+′[EW]", ""), (r"/[^/\n]*/", ""), (r"\(\s*\)", ""),
    (r"[–—]", "-"), (r"\s+([,.;:!?])", "$1"), (r"([,;:])([^\s0-9])", "$1 $2"), (r"\s+", " "),
)


def replaced(text: Column | str, patterns: tuple[str, ...], by: str = "") -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, by), patterns, col(text))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"<[^>]+>", " ")


def scrub_pii(text: Column | str) -> Column:
    """Each kind of PII replaced by its name in brackets, in the catalogue's order."""
    return reduce(lambda x, kind: F.regexp_replace(x, PII[kind], f"[{kind.upper()}]"), PII, col(text))


def scrub_urls(text: Column | str) -> Column:
    return F.regexp_replace(col(text), URL, "[URL]")


def normal_lines(text: Column | str) -> Column:
    """LF line ends, single blanks, no blanks at line ends, at most one empty line."""
    x = F.regexp_replace(col(text), "\r\n?", "\n")
    for pattern, by in ((r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def folded(text: Column | str, family: tuple[tuple[str, str], ...]) -> Column:
    """The family's patterns removed in order from a lower-cased text; one whose word is not in the text is not tried."""
    unicode = lambda p: "(?U)" + p if "\\w" in p or "\\b" in p else p
    known = [F.struct(F.lit(word).alias("word"), F.lit(r"\d" in p).alias("figures"), F.lit(unicode(p)).alias("pattern")) for word, p in family]

    def fold(x: Column) -> Column:
        # patterns of figures are tried in texts with figures only; removals make no new ones
        tried = F.when(x.rlike(r"\p{Nd}"), F.array(*known)).otherwise(F.filter(F.array(*known), lambda p: ~p["figures"]))
        return F.aggregate(tried, x, lambda y, p: F.when(F.contains(y, p["word"]), F.regexp_replace(y, p["pattern"], F.lit(""))).otherwise(y))

    return let(col(text), fold)


def cut_forwarded(text: Column | str, markers: tuple[str, ...] = FORWARD_MARKS, share: float = 0.1) -> Column:
    """Cuts at the first marker of the list that occurs, if it stands behind ``share`` of the text."""

    def made(x: Column) -> Column:
        out = x
        for m in reversed(markers):
            at = F.locate(m, F.lower(x)) - 1
            out = F.when(at >= 0, F.when(at > share * F.length(x), F.trim(F.substring(x, F.lit(1), at))).otherwise(x)).otherwise(out)
        return out

    return let(col(text), made)


def clean_mail_light(text: Column | str) -> Column:
    """Tags, blanks, quoted replies, disclaimers, promotions and forward lines, in this order; blanks are collapsed first, so line patterns see one line."""
    x = collapse_blanks(strip_tags(text))
    x = F.regexp_replace(x, r"(?i)-+ ?original message ?-+.*", "")
    return collapse_blanks(replaced(x, LIGHT_DISCLAIMERS + LIGHT_PROMOTIONS + LIGHT_FORWARDS))


def without_metadata(text: Column | str) -> Column:
    """What stands before the first Sent, To, From or Cc, with a colon, in any case: each of them takes all up to the next, and the last the rest."""
    return F.trim(F.regexp_replace(col(text), METADATA, ""))


def without_greetings(text: Column | str) -> Column:
    """Lower-case words without greetings, addresses, dates and times; other signs than apostrophes and hyphens are blanks."""
    x = replaced(text, tuple(f"(?U){p}" for p in GREETINGS))
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s'-]", " "), r"(?U)\s+", " ")
    return F.lower(x)


def clean_mail_full(text: Column | str, least: int = 30) -> Column:
    """A mail as lower-case words: metadata lines, signs, forwards, all families, addresses, links and numbers go, then lines of ten characters or fewer.

    A text that shrinks below ``least`` characters keeps its letters instead. Null counts as empty.
    """

    def made(raw: Column) -> Column:
        x = F.regexp_replace(folded(raw, CSV_LINES), SEPARATORS, " ")
        x = folded(cut_forwarded(x), FORWARDS)
        for family in (DISCLAIMERS, PROMOTIONS, SIGNATURES, ATTACHMENTS, HEADERS, LAYOUT, PRIVATE):
            x = folded(x, family)
        x = let(x, lambda y: F.when(y.rlike(URL_SIGNS), F.regexp_replace(y, BARE_URL, "")).otherwise(y))
        x = folded(x, NUMBERS)
        x = F.regexp_replace(F.regexp_replace(x, r"\d+", " "), r"[^a-z'\s]", " ")
        lines = F.filter(F.transform(F.split(x, "\n"), lambda line: F.trim(line)), lambda line: F.length(line) > 10)
        x = F.trim(F.regexp_replace(F.array_join(lines, " "), r"[ \t]+", " "))
        letters = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^a-z'\s]", " "), r"\s+", " "))
        return let(x, lambda y: F.when(F.length(y) < least, letters).otherwise(y))

    return let(F.lower(F.coalesce(col(text), F.lit(""))), made)


def clean_wiki(text: Column | str) -> Column:
    return F.trim(reduce(lambda x, p: F.regexp_replace(x, *p), WIKI, col(text)))


def strip_code_fence(text: Column | str) -> Column:
    x = F.trim(col(text))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_object_text(text: Column | str) -> Column:
    """From the first { to the last }, without thoughts and fences; null if there is none."""
    x = F.regexp_replace(col(text), r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(strip_code_fence(x), r"(?s)\{.*\}", 0), F.lit(""))
