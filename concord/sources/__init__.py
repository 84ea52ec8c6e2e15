"""Reading tables and files, writing reports."""
