"""What lines of bulletins are told by, as regular expressions of Java; notices.py reads them for Python."""

from __future__ import annotations

_NAME = r"GAZET(?:TE|E)\s+NOTICE[.]?\s+NO[.]?\s*"
HEADER = rf"(?U)^{_NAME}(\d+)\s*$"
NOISY_HEADER = rf"(?U)(?:\A|[\s|])\s*{_NAME}(\d+)[\s|]"
MIN_GAP = 40

_ORDINAL = r"(?:st|[nr]d|th)"
FURNITURE = [
    r"(?i)THE KENYA GAZETTE",
    rf"[0-9]{{1,2}}{_ORDINAL}\s+\w+[,]?\s+[0-9]{{4}}",
    r"[0-9]{4,5}",
    r"(?i)CONTENTS",
    r"(?i)" + r"\s+".join("Published by Authority of the Republic of Kenya".split()),
    r"(?i)Price\s+Sh[.]?\s*[0-9]+[,.]?[0-9]*",
    r"(?i)[(]" + r"\s+".join("Registered as a Newspaper at the".split()) + r"\s+G[.]?P[.]?O[.]?[)]",
    r"(?i)Vol[.]?\s*[CILVX]+\s*-+\s*No[.]?\s*[0-9]+",
    rf"(?i)NAIROBI\s*[,]?\s+[0-9]{{1,2}}{_ORDINAL}?\s+\w+[,]?\s+[0-9]{{4}}",
]
EXACT_CASE = "|".join(p for p in FURNITURE if "(?i)" not in p)
ANY_CASE = "|".join(p.replace("(?i)", "") for p in FURNITURE if "(?i)" in p)

#: What marks the end of notices, and at how many lines from the last header it may.
TRAILERS = [
    (r"^\s*NOW\s+ON\s+SALE\b", 10),
    (r"SUBSCRIPTION\s+(?:(?:AND\s+)?ADVERTISEMENT\s+)?CHARGES", 20),
    (r"\s+".join("IMPORTANT NOTICE TO SUBSCRIBERS".split()), 20),
    (r"Government\s+Printer[.]?\s*$", 20),
    (r"^(?:CONTENTS|INDEX)\s*$", 20),
    (r"CLASSIFIED\s+AD(?:S|VERTISEMENT)", 20),
]

#: A header in the plainer split.
PLAIN_HEADER = r"^GAZET(?:TE|E)\s+NOTICE\s+NO[.]\s*([0-9]+)\s*$"

MARKERS = sorted(["whereas", "take notice", "dated the", "in exercise", "it is notified", "in pursuance", "pursuant to", "(cap. ", "(no. "])
DATED = r"(?Ui)\bDated\s+the\s+[0-9]{1,2}(?:st|[nr]d|th)?\s+\w+[,]?\s+[0-9]{4}"
SIGNATURE = r"(?Um)^\s*[A-Z][-A-Z .,']{4,}\s*[,]?\s*$"
MID_CAPITAL = r"(?U)\s(?<=[a-z]{3}\s)\s*[A-Z][a-z]{3,}"
