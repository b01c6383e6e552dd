"""Stored plans: views, materialised views, procedures, triggers, and the statement facade."""
