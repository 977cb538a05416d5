"""The registered statements of the dialect, with the SQL that checks each."""
