"""Rule-driven extraction of dates, parties and contacts from tables of legal filings."""
