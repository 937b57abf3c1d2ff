"""Query registrations."""
