"""End-to-end jobs: data, baseline, model scoring, out-of-domain, report."""
