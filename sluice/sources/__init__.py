"""Sources and sinks: message files, attachments, tables, content-addressed blobs."""
