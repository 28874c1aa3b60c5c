"""Schemas of the tables that the library writes."""

ATTENDEE = "struct<email:string,name:string,role:string,partstat:string,cutype:string>"
MESSAGES = "source_file string, msg_pos bigint, headers array<struct<name:string,value:string>>, body binary"
MAILS = "msg_pos bigint, rcpt_idx int, `from` string, from_name string, `to` string, to_name string, subject string, content string, date bigint, source_file string"
PARSED = (
    "source_file string, msg_pos bigint, from_email string, from_name string, to array<struct<email:string,name:string>>, subject string, date bigint, content string, chars bigint, is_meeting boolean"
)
CONTACTS = "email string, name string, received bigint, sent bigint, sent_per_month double, received_per_month double, average_chars double, duration double, meetings bigint, not_spam boolean"
FILTERED = "email string, not_clear boolean"
EVENTS = (
    "event_id string, uid string, occurrence_idx bigint, summary string, description string, location string, organizer_email string, organizer_name string, "
    f"attendees array<{ATTENDEE}>, dtstart bigint, dtend bigint, created bigint, last_modified bigint, status string, transp string, sequence bigint, rrule string, is_recurring boolean, source_file string"
)
