"""Comment moderation: detectors, context suppression, decision, and the pipeline that composes them."""
