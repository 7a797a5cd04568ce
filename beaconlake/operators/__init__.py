"""DataFrame operators: ordered events in, evidence-backed tables out."""
