"""End-to-end flows, derived example tables and their SQL formulations."""
