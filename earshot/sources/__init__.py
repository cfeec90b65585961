"""Sources: tables, feeds, transcripts, queues and blobs."""
