"""Lists a report is run with by default. All are parameters of the report functions."""

import datetime as dt

# Regions always listed in the report and in the trajectory chart.
REPORT_REGIONS = ("Austria", "Netherlands", "Croatia", "Germany", "Sweden")
TRAJECTORY_REGIONS = ("Austria", "Korea, South", "Netherlands", "Croatia", "Germany", "Sweden", "Belgium")
# Fixed value: a day with a change of counting method.
OUTLIER_CELLS = (("China", dt.date(2020, 2, 13)),)
