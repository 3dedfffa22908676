"""Reading transcripts, exports, mail, calendars and files into tables."""
