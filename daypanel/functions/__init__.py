"""Column functions: missing-value rules, text and number repair, dates."""

from daypanel.functions.dates import (
    add_days,
    serial_date,
    timestamp_ymd_hms,
    weekday_label,
    date_mdy,
    date_ymd,
    date_yyyymmdd,
)
from daypanel.functions.missing import (
    clamp_below,
    cumsum_strict,
    cut_right,
    doubling_time,
    fill_zero,
    flag_above,
    in_set,
    not_in_set,
    round_even,
    sum_or_zero,
    sum_strict,
    try_div,
)
from daypanel.functions.text import (
    comma_text,
    daily_per_100,
    implied_thousands,
    num,
    num_comma,
    paste,
    repair_thousands,
    replace_first,
    strip_chars,
)
