"""DataFrame operators over postings, profiles, evaluations and runs."""
