"""Word lists and patterns the extraction rules are defined by."""

# Results depend on them exactly, so they are kept as plain text.
MONTH_WORDS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
    "aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
ISO_DATE = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
DAY_MONTH_DATE = r"(?i)\b(\d{1,2})(st|nd|rd|th)?\s+(" + MONTH_WORDS + r")\.?(?:,?\s+(\d{4}|\d{2}))?\b"
MONTH_DAY_DATE = r"(?i)\b(" + MONTH_WORDS + r")\.?\s+(\d{1,2})(st|nd|rd|th)?(?:,?\s+(\d{4}|\d{2}))?\b"
NUMERIC_DATE = r"\b(\d{1,2})\s*[/.\-]\s*(\d{1,2})(?:\s*[/.\-]\s*(\d{4}|\d{2}))?\b"
WEEKDAY_NAME = (
    r"(?i)\b(mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|"
    r"fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b"
)
PIVOT_YEAR = 2026

# Results depend on them exactly.
CLOCK = r"(\d{1,2})(?:[:.](\d{2}))?"
MARKER = r"\s*([aApP]\.?[mM]\.?)?"
TIME_RANGE = r"\b" + CLOCK + MARKER + r"\s*(?:[-–—]|to)\s*" + CLOCK + MARKER
TIME_SINGLE = r"\b" + CLOCK + MARKER

# Results depend on them exactly.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Results depend on them exactly.
ROOM_COMPOUND = r"^[A-Za-z]{1,4}\d{1,4}[-/\s][A-Za-z]{1,4}\d{1,4}[A-Za-z]?$"
ROOM_KEYWORD = r"(?i)^(room|rm|lab|hall|block|theatre|theater|lt)\.?\s*[-\s]?\w{1,6}$"
ROOM_SIMPLE = r"^[A-Za-z]{1,4}[-\s]?\d{1,4}[A-Za-z]?$"
ROOM_NUMERIC = r"^\d{1,4}[-\s]?[A-Za-z]{1,3}$"
INSTRUCTOR_PREFIX = r"(?i)\b(prof|dr|mr|mrs|ms|miss)\.?\s"
SUBJECT_SPLITTERS = r"\n|/|\||,| - | – |\(|\)"

# Results depend on them exactly.
FIELD_SEPARATOR = r"\s*[:：]\s*|\s+[–—]\s+"
TIME_LABELS = (
    "time", "reporting time", "departure", "arrival", "check-in", "check in",
    "checkout", "check-out", "boarding", "start time", "end time", "timing",
    "timings", "slot",
)
DATE_LABELS = (
    "date", "due date", "due", "last date", "valid till", "valid until", "expiry",
    "deadline", "payable by", "pay by", "on or before", "appointment date",
    "examination date", "exam date", "issue date", "journey date",
)
SUBJECT_LABELS = (
    "subject", "event", "purpose", "flight", "train", "service", "test", "exam",
    "examination", "course", "appointment", "description", "particulars", "for",
    "regarding", "re", "title", "post", "position", "bill for",
)
WHERE_LABELS = (
    "venue", "location", "place", "address", "centre", "center", "hall", "room",
    "platform", "gate", "terminal", "clinic", "hospital", "branch", "reporting at",
)

# Results depend on them exactly.
DANGLING_WORDS = (
    "is", "on", "at", "by", "from", "to", "for", "of", "in", "the", "a", "an",
    "will", "be", "was", "are", "and", "upto", "till", "until", "before", "after",
)
NARRATION_OPENERS = (
    "the", "this", "these", "those", "please", "kindly", "it", "we", "you", "all",
    "any", "as", "in", "on", "for", "with", "submissions", "applicants", "candidates",
    "students", "note", "notice",
)
DEADLINE_CUES = (
    "last date", "due date", "due on", "deadline", "submit by", "submission",
    "valid till", "valid until", "expires", "premium", "payable", "outstanding",
    "last day", "closing date",
)
TRAVEL_CUES = (
    "departure", "departs", "boarding", "check-in", "check in", "arrival", "arrives",
    "pnr", "itinerary", "gate", "terminal", "coach", "seat no",
)
APPOINTMENT_CUES = (
    "appointment", "consultation", "interview", "hearing", "visit us", "reporting time",
    "admit card", "reporting at",
)
EVENT_CUES = ("programme", "program", "agenda", "session", "conference", "fixture")
COLUMN_HEADER_WORDS = (
    "date", "dates", "day", "time", "times", "venue", "location", "room", "hall",
    "company", "status", "subject", "course", "sl", "no", "sr", "s", "from", "to",
    "reporting", "arrival", "departure", "seat", "coach", "test", "round",
)

# Results depend on them exactly.
HEADER_TIME_WORDS = ("time", "timing", "timings", "hours", "slot", "reporting")
HEADER_DATE_WORDS = (
    "date", "dated", "schedule", "departure", "arrival", "checkin", "checkout",
    "validtill", "validuntil", "expiry", "expires", "commences", "deadline",
    "duedate", "due", "journey", "issue",
)
HEADER_PLACE_WORDS = (
    "venue", "location", "place", "room", "hall", "centre", "center", "address",
    "block", "where", "platform", "gate",
)
GLUED_WORDS = ("date", "time", "day", "period", "ends", "payable")
