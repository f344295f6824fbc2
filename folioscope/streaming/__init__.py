"""Request ledgers as streams: an extension, whose results equal the batch operators' on the same rows."""
