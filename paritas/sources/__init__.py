"""Reading and writing the tables, models and reports of an evaluation."""
