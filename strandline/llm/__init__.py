"""Training-data operators: packing, deduplication, classifiers, secret scans, media and token stores."""
