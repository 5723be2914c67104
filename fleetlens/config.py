"""Constants that define the metrics. Each is a fixed value of the metric contract."""

# Ticket statuses that end a ticket's life.
TERMINAL_STATUSES = ("Closed", "Duplicate", "Junk")

# Service-level target, in days, of a category the catalog does not list.
SLA_DEFAULT_DAYS = 5

# An open ticket is at risk beyond this share of its target.
AT_RISK_SHARE = 0.75

# Lower-cased category text that marks an unlisted category as technical.
TECH_KEYWORDS = (
    "machine|device|hardware|cable|network|sim|accessor|acquisition|battery|printer|connector"
    "|adapter|display|keypad|antenna|board|tablet|charg|serial|ups|trilink|swap"
)

# Heartbeats are stored this many minutes ahead of UTC.
CLOCK_OFFSET_MINUTES = 330

# A device is online if it was heard within this many hours.
ONLINE_WINDOW_HOURS = 24

# Register entries of these types are housekeeping, not devices.
NON_DEVICE_TYPES = ("task", "epic", "test")

# Register statuses the default filter set hides.
DEFAULT_STATUS_EXCLUDE = ("Decommissioned",)
DEFAULT_CENTER_STATUSES = ("ACTIVE",)

# Outcomes of an escalation.
RESOLVED_OUTCOMES = ("Issue Resolved", "Auto Resolved")
UNRESOLVED_OUTCOMES = ("Not resolved", "No response")

# A device serial inside free text.
SERIAL_PATTERN = "([A-Za-z0-9]{2}-[A-Za-z0-9]{6,})"

# Country assumed for a location that names none.
DEFAULT_COUNTRY = "India"

# Marker of a location that cannot be resolved to coordinates.
UNRESOLVABLE = "x"
