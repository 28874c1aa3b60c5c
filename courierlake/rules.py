"""Fixed values of the rules: word lists, host lists and constants, as data."""

# Mailbox names of senders that cannot be answered.
NOREPLY = ["noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "do_not_reply", "donot-reply"]

# Mailbox names of systems.
AUTOMATED = [
    "mailer-daemon", "mailerdaemon", "postmaster", "automail", "auto-mail", "automated", "automatic", "daemon", "system", "admin", "root", "bounce",
    "notification", "notifications", "alert", "alerts",
]

# Mailbox names of marketing senders.
MARKETING = [
    "newsletter", "news-letter", "marketing", "promo", "promotion", "promotions", "campaign", "campaigns", "offer", "offers", "deals", "sale", "sales",
    "subscribe", "subscription", "unsubscribe", "info", "support", "contact", "hello", "team", "updates", "digest", "weekly", "daily", "monthly",
    "announce", "announcement", "broadcast",
]

# Domains whose mail (and whose subdomains' mail) is never personal.
BLOCKED_DOMAINS = [
    "sendgrid.net", "sendgrid.com", "mailchimp.com", "mailgun.org", "mailgun.com", "amazonses.com", "mandrillapp.com", "postmarkapp.com", "sparkpostmail.com",
    "constantcontact.com", "hubspot.com", "hubspotmail.com", "intercom.io", "intercom-mail.com", "facebookmail.com", "twittermail.com", "linkedin.com",
    "linkedinmail.com", "pinterest.com", "instagram.com", "shopify.com", "ebay.com", "paypal.com", "substack.com", "beehiiv.com", "convertkit.com",
    "buttondown.email", "getrevue.co",
]

# Phrases in display names of automated senders.
NAME_PHRASES = ["noreply", "no-reply", "do not reply", "automated", "system notification"]

# Hosts of scheduling and meeting services.
SCHEDULING_HOSTS = [
    "meet.google.com", "calendar.google.com", "calendly.com", "cal.com", "doodle.com", "youcanbook.me", "ycbm.com", "acuityscheduling.com", "chilipiper.com",
    "hubspot.com/meetings", "meetings.hubspot.com", "savvycal.com", "tidycal.com", "zencal.io", "reclaim.ai", "sprintful.com", "10to8.com", "zeeg.me",
    "sumoscheduler.com", "brevo.com/meetings", "zoho.com/bookings", "bookings.zoho.com", "appointlet.com", "setmore.com", "simplybook.me", "square.site/book",
    "squareup.com/appointments", "vcita.com", "oncehub.com", "scheduleonce.com", "harmonizely.com", "picktime.com", "supersaas.com", "vyte.in", "appointy.com",
    "booksy.com", "gettyimages.com/schedule", "koalendar.com", "meetingbird.com", "rallly.co", "when2meet.com", "lettucemeet.com", "zoom.us/j/", "zoom.us/my/",
    "teams.microsoft.com/l/meetup-join", "webex.com/meet",
]

# Phrases of calendar mail, lower case.
MEETING_PHRASES = [
    "text/calendar", "application/ics", "begin:vcalendar", "begin:vevent", "calendar-notification@google.com", "invitation from google calendar",
    "you have been invited to the following event", "accept this invitation", "google calendar: ", "has invited you to a meeting", "join the meeting",
    "meeting invitation", "calendar invitation", "event invitation", "scheduled a meeting", "meeting scheduled", "booking confirmed", "appointment confirmed",
    "your meeting with", "meeting with ",
]

# Mailbox providers that say nothing about an organisation.
PERSONAL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "mail.com", "protonmail.com"]

# Recurrence rule parts that are not expanded.
UNSUPPORTED_RULE_KEYS = ["BYSETPOS", "BYWEEKNO", "BYMONTHDAY", "BYYEARDAY", "BYMONTH", "BYHOUR", "BYMINUTE", "BYSECOND"]
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]

# Character set names by the codec that reads them.
CHARSETS = {
    "iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "windows-1252": "cp1252", "cp1252": "cp1252",
    "iso-8859-2": "iso8859-2", "latin2": "iso8859-2", "latin-2": "iso8859-2", "windows-1251": "cp1251", "cp1251": "cp1251", "koi8-r": "koi8-r", "koi8-u": "koi8-u",
    "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932",
    "euc-jp": "euc-jp", "euc-kr": "cp949", "iso-2022-jp": "iso2022_jp",
}

# Colours of groups by their place.
PALETTE_SIZE = 8

DAYS_PER_MONTH = 30.44
CENTER_SCORE = 999999999
BORDA_WINDOW, BORDA_TOP, CALENDAR_WEIGHT = 150, 300, 0.5
COEFFICIENTS = {"sent": 1.0, "received": 0.2}
MEETINGS_BONUS = 300
MIN_GROUP, MAX_ROPE = 3, 8
LOOKBACK_DAYS, MAX_OCCURRENCES = 730, 10_000
