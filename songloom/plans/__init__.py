"""Registered queries, the views they read and the SQL that checks them."""
