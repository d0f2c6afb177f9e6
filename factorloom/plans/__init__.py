"""Registered queries: a name, a Spark plan over the tables of a folder, and where SQL can say it the same in SQL."""
