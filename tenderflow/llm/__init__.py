"""Training-data operators: packing, secret scans, substring dedup, chat formatting, sharding,
quality rules, decontamination, licence scans, URL filters, SimHash near-dedup, spelling variants,
embedding whitening and nearest neighbours."""
