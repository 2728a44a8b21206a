"""Readers and writers for evaluation dumps, labelled sheets and result tables."""
