"""Closed vocabularies of the canonical table."""

# They decide what every source's spelling becomes, and results depend on each of them.
SITES = ("linkedin", "indeed", "glassdoor")
PERIODS = {
    "HOURLY": "HOURLY", "HOUR": "HOURLY", "PER_HOUR": "HOURLY", "HOURLY_RATE": "HOURLY",
    "DAILY": "DAILY", "DAY": "DAILY", "PER_DAY": "DAILY",
    "WEEKLY": "WEEKLY", "WEEK": "WEEKLY", "PER_WEEK": "WEEKLY",
    "MONTHLY": "MONTHLY", "MONTH": "MONTHLY", "PER_MONTH": "MONTHLY",
    "YEARLY": "ANNUAL", "YEAR": "ANNUAL", "ANNUAL": "ANNUAL", "ANNUALLY": "ANNUAL", "PER_YEAR": "ANNUAL", "YEARLY_RATE": "ANNUAL",
}
EMPLOYMENT = {
    "FULL_TIME": "FULL_TIME", "FULLTIME": "FULL_TIME",
    "PART_TIME": "PART_TIME", "PARTTIME": "PART_TIME",
    "CONTRACT": "CONTRACT", "CONTRACTOR": "CONTRACT",
    "TEMPORARY": "TEMPORARY", "TEMP": "TEMPORARY",
    "INTERNSHIP": "INTERNSHIP", "INTERN": "INTERNSHIP",
    "PERMANENT": "PERMANENT",
    "VOLUNTEER": "VOLUNTEER",
}
EMPLOYMENT_ORDER = ("FULL_TIME", "PART_TIME", "CONTRACT", "TEMPORARY", "INTERNSHIP", "PERMANENT", "VOLUNTEER")
WORKPLACE = {
    "REMOTE": "REMOTE", "FULLY_REMOTE": "REMOTE", "WORK_FROM_HOME": "REMOTE",
    "HYBRID": "HYBRID",
    "ONSITE": "ONSITE", "ON_SITE": "ONSITE", "IN_PERSON": "ONSITE", "IN_OFFICE": "ONSITE",
    "URN:LI:FS_WORKPLACETYPE:1": "ONSITE", "URN:LI:FS_WORKPLACETYPE:2": "REMOTE", "URN:LI:FS_WORKPLACETYPE:3": "HYBRID",
}
WORKPLACE_ORDER = ("REMOTE", "HYBRID", "ONSITE")
SILENT = ("OTHER",)
EMPLOYER_SET = ("EMPLOYER", "EMPLOYER_PROVIDED", "EMPLOYER_PROVIDED_SALARY", "EXTRACTION")
ESTIMATE_SET = ("ESTIMATE", "ESTIMATED", "INDEED_ESTIMATE", "GLASSDOOR_ESTIMATE")
EPOCH_MS = (946684800000, 4102444800000)
