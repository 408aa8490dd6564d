"""Row types of the engine's tables."""

#: The payload fields the operators look at.
PAYLOAD = (
    "type string, rotationKeys array<string>, verificationMethods map<string,string>, signingKey string, "
    "alsoKnownAs array<string>, handle string, services map<string,struct<type:string,endpoint:string>>, service string, prev string, sig string"
)
ENVELOPE = f"did string, operation struct<{PAYLOAD.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>, cid string, nullified boolean, createdAt string, created_at string"
OPERATIONS = "bundle int, position int, global_pos long, did string, cid string, nullified boolean, created_at string, raw string"
MANIFEST = (
    "bundle_number int, start_time string, end_time string, operation_count int, did_count int, hash string, content_hash string, parent string, "
    "compressed_hash string, compressed_size long, uncompressed_size long, cursor string, created_at string"
)
