"""File scans, versioned saves and the template renderer."""
