"""A small lexicon for the synthetic corpus. Lexicons are inputs; replace them for other texts."""

from ..functions.lexicon import Amounts, Corporate

POLICY = [(100, ["License"]), (95, ["token"]), (80, ["rights reserved"]), (60, ["example.com"]), (40, ["tion the"]), (20, ["the"])]
CORPORATE = Corporate(["Public"], ["version"], ["Apache"], ["password"], ["eson"], ["ein"])
FOOD = ["onandedth"]
INDUSTRY = [(100, ["Licensed"]), (80, ["worthless"]), (75, ["thatthe"]), (60, ["ación"]), (40, ["ing"])]
MONEY = Amounts(("555", 1e7), ("rights", 1e11), ("at", 1e8))
SCOPE = [(20, ["License"]), (15, ["mail"]), (10, ["tion"])]
GEOGRAPHY = [(100, ["Auf"]), (80, ["sur"]), (70, ["los"]), (60, ["over"]), (50, ["der"])]
TIME = [(100, ["today"]), (90, ["now"]), (70, ["on the"]), (50, ["in the"])]
INTERNATIONAL = [(100, ["+1"]), (90, ["con"]), (80, ["entre"]), (75, ["nder"]), (60, ["es"])]
SOCIAL = [(100, ["mail"]), (80, ["idiot"]), (70, ["con"]), (60, ["her"]), (50, ["he"])]
BOOSTERS = [("wide", 1.5, ["License"]), ("deep", 1.3, ["rights"])]
CATEGORIES = {"law": ["License", "rights"], "web": ["mail", "example"], "code": ["token", "password"], "prose": ["the", "der", "les", "los"]}
OPINION = ["idiot", "moron", "stupid"]
ADMINISTRATIVE = ["example.com", "token"]
NOTICE = ["der ", "die "]
EXEMPT = ["src1", "src7"]
CONCRETE = ["the", "version", "License"]
AMOUNTS = r"\d+[.,]\d+|\d{4,}"
BRIEF = r"^(?:In brief|Short)"
HOME, ABROAD = ["the", "and", "of"], ["der", "les", "los", "und"]
FACT_PATTERNS = [r"\d{3}", r"\d\.\d", r"\d+%", r"\(\d+\)", r"@"]
FACTS = ["that", "was", "with", "by", "from"]
BROAD, DEEP = ["tion", "all", "le"], ["ing", "ein", "que"]
EXCLUDED, STRONG, WEAK = ["Short"], ["License", "rights"], ["the", "er", "le", "an"]
