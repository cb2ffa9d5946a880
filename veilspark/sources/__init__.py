"""Reading: table scans, text files, rule sheets, configuration files, scratch tables."""
