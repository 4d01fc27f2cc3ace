"""Reading tables, describing their structure, and storing results."""
