"""Fixed values of the application: thresholds, durations and label texts."""

# They decide results and must not drift between jobs.
ALERT_SPEED_BELOW = 10.0  # km/h, strict: alerts and event status
REPORT_SPEED_BELOW = 15.0  # km/h, strict: report labels

WINDOW_WIDTH = "5 minutes"
WATERMARK_DELAY = "10 minutes"
TRAILING_HOURS = 24
MAX_HOUR_LABELS = 12

STATUS_CRITICAL = "CRITICAL"
STATUS_NORMAL = "NORMAL"

INTERVENE = "Yes"
WATCH = "Monitor"

ADVICE_TOP_RANK = "Priority police deployment"
ADVICE_SLOW = "Deploy if speeds drop below 15 km/h"
ADVICE_DEFAULT = "Continue monitoring"
