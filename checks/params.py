"""Parameters that the registered queries and their SQL share."""

from datetime import UTC, datetime

from mailverdict.functions.timerange import TimeRange, last_days

NOW = datetime(2001, 3, 15, 12, 30, tzinfo=UTC)
MONTH = last_days(NOW)

# All of the derived fact rows end between 1995 and 2001, all events in January 2024.
ALL_TIME = TimeRange(788918400, 1009843199)
EVENTS = TimeRange(1703462400, 1707566399)

DOMAIN = "d3.example.com"
EVENT_DOMAIN = "u2.example.org"
SEARCH = "D1"
DETAIL_QUERY = "B1.Example"

# One source of each kind.
SOURCES = {
    "detail_esp": ("Google Mail", "ESP"),
    "detail_domain": ("sd3.example.net", "SourceDomain"),
    "detail_host": ("mail6.example.net", "SourceHost"),
    "detail_ip": ("2001:db8::9", "SourceIP"),
    "detail_bad_type": ("Google Mail", "Provider"),
}
PAGE, PAGE_SIZE = 1, 100

# Mails up to here come in a first run, all mails in a second one.
FIRST_RUN_END = 883612800
