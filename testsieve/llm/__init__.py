"""Operators of a training-data pipeline (extraction, tokenisation, filters,
fingerprints, near-duplicate and contamination search).  Nothing else in the
package imports this subpackage."""
