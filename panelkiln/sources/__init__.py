"""Tables in and out: schemas, panels, manifests, reports."""
